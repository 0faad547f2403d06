"""SQL fragments shared by the query counterparts."""

IMAGES = """
images AS (
  SELECT 'img/' || o_orderkey AS image_id,
         '/corpus/' || o_orderstatus || '/' || o_orderkey || '.jpg' AS file_path,
         CAST(o_custkey % 1600 + 320 AS INTEGER) AS width,
         CAST(o_orderkey % 1200 + 240 AS INTEGER) AS height,
         o_orderpriority AS source,
         CASE o_custkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'unlisted' END AS split_hint,
         'grp/' || o_custkey AS group_id
  FROM orders)"""

COUNTED = IMAGES + """,
counted AS (
  SELECT i.*, coalesce(c.n, 0) AS n_instances
  FROM images i LEFT JOIN (
    SELECT 'img/' || l_orderkey AS image_id, count(*) AS n FROM lineitem GROUP BY 1) c
  USING (image_id))"""

# Rectangles x, y, w, h of line items; pos orders them inside an image.
BOXES = """
boxes AS (
  SELECT 'img/' || l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax,
         l_returnflag || l_linestatus AS source_class,
         CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey % 700 AS DOUBLE) AS y,
         CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_quantity END AS w,
         CAST(l_linenumber * 3 AS DOUBLE) AS h
  FROM lineitem)"""

MAPPING = """
mapping(source_class, canonical, decision) AS (VALUES
  ('AF', 'scratch', 'map'), ('AO', 'dent', 'map'), ('NF', 'crack', 'keep_specific'),
  ('NO', 'lamp_broken', 'map'), ('RF', CAST(NULL AS VARCHAR), 'exclude'), ('RO', CAST(NULL AS VARCHAR), 'exclude'))"""


def split(corpus="''", official="FALSE", seed=42, source="counted"):
    """CTE chain ending in ``assignment(corpus, group_id, split)``."""
    return f"""
profile AS (
  SELECT {corpus} AS corpus, group_id, count(*) AS n_images,
         CAST(sum(n_instances) AS DOUBLE) / count(*) AS density,
         min(split_hint) AS hint
  FROM {source} GROUP BY 1, 2),
pins AS (
  SELECT *, CASE WHEN {official} AND hint IN ('train', 'val', 'test') THEN hint END AS pinned
  FROM profile),
caps AS (
  SELECT corpus, count(*) FILTER (pinned IS NULL) AS n_free,
    greatest(0.8::DOUBLE * sum(n_images) - coalesce(sum(n_images) FILTER (pinned = 'train'), 0), 0::DOUBLE) AS c0,
    greatest(0.1::DOUBLE * sum(n_images) - coalesce(sum(n_images) FILTER (pinned = 'val'), 0), 0::DOUBLE) AS c1,
    greatest(0.1::DOUBLE * sum(n_images) - coalesce(sum(n_images) FILTER (pinned = 'test'), 0), 0::DOUBLE) AS c2
  FROM pins GROUP BY 1),
ratios AS (
  SELECT corpus, n_free,
    CASE WHEN c0 + c1 + c2 <= 0 THEN 0.8::DOUBLE ELSE c0 / (c0 + c1 + c2) END AS r0,
    CASE WHEN c0 + c1 + c2 <= 0 THEN 0.1::DOUBLE ELSE c1 / (c0 + c1 + c2) END AS r1
  FROM caps),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY density, group_id) - 1 AS i
  FROM pins WHERE pinned IS NULL),
strata AS (
  SELECT ranked.*, r0, r1, (i * greatest(1, least(3, n_free))) // n_free AS stratum,
         substr(sha256('{seed}:' || group_id), 1, 16) AS h
  FROM ranked JOIN ratios USING (corpus)),
placed AS (
  SELECT *,
    coalesce(sum(n_images) OVER (PARTITION BY corpus, stratum ORDER BY h, group_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed,
    sum(n_images) OVER (PARTITION BY corpus, stratum) AS total
  FROM strata),
assignment AS (
  SELECT corpus, group_id,
    CASE WHEN placed < r0 * total THEN 'train'
         WHEN placed < r0 * total + r1 * total THEN 'val' ELSE 'test' END AS split
  FROM placed
  UNION ALL
  SELECT corpus, group_id, pinned FROM pins WHERE pinned IS NOT NULL)"""

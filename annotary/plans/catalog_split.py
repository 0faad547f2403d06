"""Split, session, sampling and ordering queries."""

from pyspark.sql import functions as F

from annotary.functions import naming
from annotary.operators import intervals, sampling, sessions, split, stats
from annotary.plans import sql, standin
from annotary.plans.catalog import query


@query(f"""WITH {sql.COUNTED}, {sql.split()}
SELECT image_id, group_id, split FROM counted JOIN assignment USING (group_id)""")
def group_split(spark, sf_dir):
    profile = split.group_profile(standin.counted_images(spark, sf_dir))
    assignment = split.assign_groups(profile, seed=42)
    images = standin.images(spark, sf_dir).select("image_id", "group_id")
    return split.attach_split(images, assignment)


@query(f"""WITH {sql.COUNTED}, {sql.split(official="TRUE")}
SELECT image_id, group_id, split FROM counted JOIN assignment USING (group_id)""")
def group_split_official(spark, sf_dir):
    images = standin.counted_images(spark, sf_dir)
    return split.group_split(images, seed=42, keep_official=True).select(
        "image_id", "group_id", "split"
    )


@query(f"""WITH {sql.COUNTED},
named AS (SELECT * REPLACE (source || '/' || group_id AS group_id) FROM counted),
{sql.split("source", "corpus = '1-URGENT'", source="named")}
SELECT source, split, count(*) AS n_images, CAST(sum(n_instances) AS BIGINT) AS n_instances
FROM named JOIN assignment ON named.group_id = assignment.group_id AND source = corpus
GROUP BY 1, 2""")
def group_split_by_source(spark, sf_dir):
    images = standin.counted_images(spark, sf_dir).withColumn(
        "group_id", F.concat("source", F.lit("/"), "group_id")
    )
    done = split.group_split(images, seed=42, keep_official=["1-URGENT"], corpus="source")
    return done.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("n_instances").alias("n_instances")
    )


@query(f"""WITH {sql.COUNTED}, {sql.split()}
SELECT stratum, count(*) AS n_groups, CAST(sum(n_images) AS BIGINT) AS n_images,
       round(min(density), 6) AS density_min, round(max(density), 6) AS density_max
FROM strata GROUP BY 1""")
def density_strata(spark, sf_dir):
    profile = split.group_profile(standin.counted_images(spark, sf_dir))
    strata = split.assign_groups(profile, seed=42).join(profile.drop("corpus"), "group_id")
    return strata.groupBy(F.col("stratum").cast("long").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n_images").alias("n_images"),
        F.round(F.min("density"), 6).alias("density_min"),
        F.round(F.max("density"), 6).alias("density_max"),
    )


@query(f"""WITH {sql.IMAGES},
leaky AS (
  SELECT group_id, CASE WHEN substr(sha256('7:' || image_id), 1, 1) <= 'b' THEN 'train'
                        WHEN substr(sha256('7:' || image_id), 1, 1) <= 'd' THEN 'val'
                        ELSE 'test' END AS split
  FROM images)
SELECT group_id, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) AS n_images
FROM leaky GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leak_check(spark, sf_dir):
    first = F.substring(naming.seeded_hash(7, "image_id"), 1, 1)
    leaky = standin.images(spark, sf_dir).withColumn(
        "split", F.when(first <= "b", "train").when(first <= "d", "val").otherwise("test")
    )
    return split.find_leaks(leaky)


@query("""WITH flagged AS (
  SELECT event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 60 SECOND
                            THEN event_id END AS head
  FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT event_id, last_value(head IGNORE NULLS) OVER (ORDER BY ts, event_id) AS session_id
FROM flagged""")
def session_merge(spark, sf_dir):
    events = standin.table(spark, sf_dir, "events").select("event_id", "ts")
    return sessions.merge_sessions(events, "event_id", "ts").select("event_id", "session_id")


@query("""WITH flagged AS (
  SELECT event_id, user_id, ts,
         CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 3600 SECOND
              THEN event_id END AS head
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id,
       last_value(head IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_id
FROM flagged""")
def session_merge_by_user(spark, sf_dir):
    events = standin.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sessions.merge_sessions(events, "event_id", "ts", ["user_id"], 3600).select(
        "event_id", "user_id", "session_id"
    )


_NAMES_SQL = """names AS (
  SELECT event_id, CASE event_id % 3
    WHEN 0 THEN strftime(ts, '%d%m%Y_%H%M%S') || 'image' || event_id || '.jpg'
    WHEN 1 THEN strftime(ts, '%Y%m%d_%H%M%S') || '.jpg'
    ELSE 'IMG_' || event_id || '.jpg' END AS file_name
  FROM events),
groups AS (
  SELECT event_id, file_name, CASE WHEN regexp_matches(file_name, '^[0-9]{8}_[0-9]{6}')
    THEN file_name[1:15] ELSE file_name END AS gid FROM names),
timed AS (
  SELECT *, CASE WHEN regexp_full_match(gid, '[0-9]{8}_[0-9]{6}') THEN
    coalesce(try_strptime(gid, '%d%m%Y_%H%M%S'), try_strptime(gid, '%Y%m%d_%H%M%S')) END AS clock
  FROM groups)"""


def _named_events(spark, sf_dir):
    kind = F.col("event_id") % 3
    eid = F.col("event_id").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.date_format("ts", "ddMMyyyy_HHmmss"), F.lit("image"), eid, F.lit(".jpg")))
        .when(kind == 1, F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .otherwise(F.concat(F.lit("IMG_"), eid, F.lit(".jpg")))
    )
    return standin.table(spark, sf_dir, "events").select("event_id", name.alias("file_name"))


@query(f"""WITH {_NAMES_SQL}
SELECT event_id, gid AS group_id, epoch_us(clock) AS clock FROM timed""")
def timestamp_groups(spark, sf_dir):
    gid = naming.timestamp_group("file_name")
    return (
        _named_events(spark, sf_dir)
        .withColumn("group_id", gid)
        .select(
            "event_id",
            "group_id",
            naming.group_micros("group_id").alias("clock"),
        )
    )


@query(f"""WITH {_NAMES_SQL},
ids AS (SELECT DISTINCT gid, clock FROM timed WHERE clock IS NOT NULL),
flagged AS (
  SELECT gid, clock, CASE WHEN lag(clock) OVER w IS NULL
      OR clock - lag(clock) OVER w > INTERVAL 60 SECOND THEN gid END AS head
  FROM ids WINDOW w AS (ORDER BY clock, gid)),
heads AS (SELECT gid, last_value(head IGNORE NULLS) OVER (ORDER BY clock, gid) AS head FROM flagged)
SELECT event_id, coalesce(head, gid) AS group_id FROM timed LEFT JOIN heads USING (gid)""")
def session_groups(spark, sf_dir):
    records = _named_events(spark, sf_dir).withColumn(
        "group_id", naming.timestamp_group("file_name")
    )
    return sessions.merge_session_groups(records).select("event_id", "group_id")


@query("""WITH named AS (
  SELECT event_id, 'g' || user_id AS group_id, CASE
    WHEN event_id % 4 = 0 THEN 'Thumbnail' || (event_id + 1) || '.jpg'
    WHEN event_id % 10 = 9 THEN (event_id - 2) || '.jpg' ELSE event_id || '.jpg' END AS name
  FROM events),
twins AS (SELECT name, arg_max(group_id, event_id) AS twin FROM named GROUP BY 1)
SELECT event_id, CASE WHEN n.name LIKE 'Thumbnail%' THEN coalesce(twin, group_id) ELSE group_id END AS group_id
FROM named n LEFT JOIN twins t ON t.name = substr(n.name, 10) AND n.name LIKE 'Thumbnail%'""")
def thumbnail_link(spark, sf_dir):
    eid = F.col("event_id")
    name = (
        F.when(eid % 4 == 0, F.concat(F.lit("Thumbnail"), (eid + 1).cast("string"), F.lit(".jpg")))
        .when(eid % 10 == 9, F.concat((eid - 2).cast("string"), F.lit(".jpg")))
        .otherwise(F.concat(eid.cast("string"), F.lit(".jpg")))
    )
    records = standin.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group_id"),
        F.concat(F.lit("/corpus/"), name).alias("file_path"),
    )
    return sessions.link_thumbnails(records, load_order="event_id").select("event_id", "group_id")


@query(f"""WITH {sql.IMAGES}
SELECT image_id, source FROM images ORDER BY substr(sha256('42:' || image_id), 1, 16), image_id LIMIT 500""")
def seeded_subset(spark, sf_dir):
    images = standin.images(spark, sf_dir)
    return sampling.seeded_subset(images, 500, 42).select("image_id", "source")


@query(f"""WITH {sql.IMAGES}, half AS (SELECT count(*) // 2 AS k FROM images),
ranked AS (SELECT image_id, row_number() OVER (
    ORDER BY substr(sha256('42:' || image_id), 1, 16), image_id) AS r FROM images)
SELECT image_id FROM ranked, half WHERE r <= k""")
def seeded_half(spark, sf_dir):
    """Half of all images."""
    images = standin.images(spark, sf_dir).select("image_id")
    return sampling.seeded_subset(images, images.count() // 2, 42)


@query(f"""WITH {sql.COUNTED}
SELECT image_id, n_instances FROM counted WHERE n_instances >= 4
ORDER BY substr(sha256('43:' || image_id), 1, 16), image_id LIMIT 200""")
def density_sample(spark, sf_dir):
    images = standin.counted_images(spark, sf_dir)
    return sampling.density_sample(images, 200, 43, 4).select("image_id", "n_instances")


@query(f"""WITH {sql.COUNTED}
SELECT image_id, source, CAST(rank AS INTEGER) AS rank FROM (
  SELECT image_id, source, row_number() OVER (PARTITION BY source
    ORDER BY substr(sha256('44:' || image_id), 1, 16), image_id) AS rank
  FROM counted WHERE n_instances > 0) WHERE rank <= 9""")
def source_sample(spark, sf_dir):
    annotated = standin.instances(spark, sf_dir).select("image_id")
    return sampling.sample_per_source(
        standin.images(spark, sf_dir), annotated, 9, 44
    ).select("image_id", "source", "rank")


@query(f"""WITH {sql.COUNTED}, buckets(label, lo, hi) AS (
  VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4+', 4, CAST(NULL AS INTEGER)))
SELECT source, label, count(*) AS n_images FROM counted JOIN buckets
  ON n_instances >= lo AND (hi IS NULL OR n_instances <= hi) GROUP BY 1, 2""")
def strata_sizes(spark, sf_dir):
    buckets = spark.createDataFrame(stats.DENSITY_STRATA, "label string, lo int, hi int")
    return stats.strata_sizes(standin.counted_images(spark, sf_dir), buckets)


@query("""SELECT 'part ' || p_partkey AS label, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total
FROM lineitem JOIN part ON l_orderkey BETWEEN p_partkey * 10 AND p_partkey * 10 + 6 GROUP BY 1""")
def interval_strata(spark, sf_dir):
    """Line items by the part in whose key range their order key lies: as many intervals as parts."""
    key = F.col("p_partkey") * 10
    parts = standin.table(spark, sf_dir, "part").select(
        key.alias("lo"), (key + 6).alias("hi"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("label")
    )
    lines = standin.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    found = intervals.interval_lookup(lines, "l_orderkey", parts)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("total"))

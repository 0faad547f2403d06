"""Queries that judge each text alone."""

from pyspark.sql import functions as F

from annotary.llm import hashed_model, language, pseudonyms, quality_rules, secrets, url_lists
from annotary.llm.registry import query, table

_OP1 = r"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT rid, i, [w, lead(w) OVER o, lead(w, 2) OVER o] AS g FROM s WINDOW o AS (PARTITION BY rid ORDER BY i)),
hit AS (SELECT rid, i FROM tri WHERE g[3] IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM hit) GROUP BY 1),
top AS (SELECT rid, max(n) AS n FROM (SELECT rid, w, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
stop AS (SELECT rid, count(*) AS n FROM s WHERE lower(w) IN (STOPWORDS) GROUP BY 1),
l AS (SELECT rid, unnest(string_split(x, chr(10))) AS line FROM t),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS k,
    count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*|•]')) AS bullets,
    count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS dots
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    greatest(strlen(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')), 1) AS word_bytes,
    length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_lines,
    coalesce(lines.n - lines.k, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS top,
    coalesce(stop.n, 0) AS stops, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots,
    strlen(regexp_replace(x, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS letters,
    length(regexp_replace(x, '[^A-Z]', '', 'g')) AS uppers
  FROM t JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN top USING (rid)
  LEFT JOIN stop USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1 * n_words OR (letters > 0 AND uppers > 0.5 * letters)
    OR letters < 0.6 * word_bytes OR word_bytes < 2 * n_words OR word_bytes > 16 * n_words
    OR n_dup_lines > 0.3 * n_lines OR top > 0.3 * n_words OR stops < 2
    OR (n_lines > 2 AND bullets > 0.9 * n_lines) OR (n_lines > 2 AND dots > 0.3 * n_lines)) AS kept
FROM judged""".replace("STOPWORDS", ", ".join(f"'{w.decode()}'" for w in sorted(quality_rules.STOPWORDS)))


@query(_OP1)
def op1_quality_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_cascade(docs)


@query()
def op4_language_cross_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), language.learn(docs))


@query()
def op8_quality_ftrl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hashed_model.score_quality(docs, table(spark, sf_dir, "labels"))


@query()
def op3_pii_feistel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="corpus pseudonyms, edition 1")


@query()
def op2_secret_forest(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


_OP5 = r"""WITH hosts AS (SELECT page_id, url, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host FROM pages),
marks AS (SELECT e.event_id AS seq, e.ts, e.value >= 60 AS active, CASE WHEN e.event_id % 4 = 3 THEN 'allow' ELSE 'block' END AS list,
    string_split(h.host, '.') AS labels, CAST(e.event_id % 3 AS INTEGER) AS up
  FROM events e JOIN hosts h ON h.page_id = e.user_id WHERE h.host IS NOT NULL),
entries AS (SELECT seq, ts, active, list, array_to_string(labels[least(1 + up, greatest(len(labels) - 1, 1)):], '.') AS pattern FROM marks),
spans AS (SELECT list, pattern, active, ts AS start, lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts, seq) AS stop FROM entries),
captures AS (SELECT h.page_id, h.url, h.host, e.ts AS fetched FROM hosts h LEFT JOIN events e ON e.event_id = h.page_id),
asked AS (SELECT DISTINCT host, fetched, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS rank FROM captures WHERE host IS NOT NULL AND fetched IS NOT NULL),
wide AS (SELECT *, array_to_string(string_split(host, '.')[rank:], '.') AS pattern FROM asked),
hit AS (SELECT w.host, w.fetched, w.rank, w.pattern, s.list FROM wide w JOIN spans s ON s.pattern = w.pattern AND s.active
    AND s.start <= w.fetched AND (s.stop IS NULL OR s.stop > w.fetched)
  QUALIFY row_number() OVER (PARTITION BY w.host, w.fetched ORDER BY w.rank, s.list) = 1)
SELECT c.page_id, c.url, c.fetched, c.host, hit.pattern AS decided_by, hit.list, coalesce(hit.list <> 'block', TRUE) AS kept
FROM captures c LEFT JOIN hit ON hit.host = c.host AND hit.fetched = c.fetched"""


@query(_OP5)
def op5_url_asof(spark, sf_dir):
    """Pages fetched at the time of the event of their number; events of a user are dated list
    entries on the host, or a parent domain, of the page of that number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    times = events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched"))
    hosts = pages.select(F.col("page_id").alias("user_id"), url_lists.host_of(F.col("url")).alias("host")).filter("host is not null")
    patterns = url_lists.patterns_of(F.col("host"))
    up = F.least(F.col("event_id") % 3, F.size(patterns) - 1).cast("int")
    entries = events.join(hosts, "user_id").select(
        F.when(F.col("event_id") % 4 == 3, "allow").otherwise("block").alias("list"),
        F.get(patterns, up).alias("pattern"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("value") >= 60).alias("active"),
    )
    return url_lists.filter_urls(pages.join(times, "page_id", "left"), entries)

"""Queries on the words of all texts."""

import string

from annotary.llm import spelling
from annotary.llm.registry import query, table

_OP11 = r"""WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'UPPER', 'LOWER'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
met AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END)) AS b FROM met),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h
  FROM coded, bits),
spoilt AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT word, n, rest FROM cut),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, s.word, s.n FROM v JOIN shorter s ON s.rest = v.word
  UNION SELECT s.word, v.word, v.n FROM v JOIN shorter s ON s.rest = v.word),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
led AS (SELECT v.word, v.n, CASE WHEN b.n >= 10 * v.n THEN b.other END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n,
    coalesce(n_near, 0) AS n_near FROM v LEFT JOIN best b USING (word)),
walk AS (SELECT word, form AS led_to, 1 AS step FROM led WHERE form IS NOT NULL
  UNION ALL SELECT w.word, l.form, step + 1 FROM walk w JOIN led l ON l.word = w.led_to WHERE l.form IS NOT NULL),
root AS (SELECT word, arg_max(led_to, step) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM led LEFT JOIN root USING (word)""".replace(
    "UPPER", string.ascii_uppercase
).replace("LOWER", string.ascii_lowercase)


@query(_OP11)
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))

from annotary.llm import secrets as sc
from tests.conftest import SF_DIR

TOKEN = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
TEXTS = [
    f'the thing token = "{TOKEN}" and more', f"see commit {TOKEN} for it", "mail bo.34@mail77.example.com now", None, "", "plain words only",
    f'token = "{TOKEN}" again token = "{TOKEN}".', "x " * 60_000 + f'secret="{TOKEN}"', "images/holiday-2019-beach-old.png",
]


def test_finds_secrets_and_leaves_the_rest(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    findings = sc.labelled_findings(docs, ids=100)
    rows = [(k, t, "k", 3) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "k", 3), (0, TEXTS[0], "k", 3)]
    mine = spark.createDataFrame(rows, "doc_id long, text string, key string, n_chars long")
    got = sc.scan_secrets(mine, findings).collect()
    secret = sorted((-1 if r.doc_id is None else r.doc_id, r.start) for r in got if r.is_secret)
    at = TEXTS[0].index(TOKEN) + 1
    assert secret == [(-1, at), (0, at), (0, at), (6, 10), (6, 67), (7, 120_009)]
    assert all(r.length >= 12 and 0 <= r.score <= 1 for r in got)
    out = sc.redact(mine, findings)
    assert out.columns == mine.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and texts[0].text == TEXTS[0].replace(TOKEN, sc.MASK) and texts[0].n_chars == len(texts[0].text)
    assert texts[1].text == TEXTS[1] and texts[1].n_chars == 3 and texts[3].text is None and texts[6].text.count(sc.MASK) == 2


def test_held_out_labelled_findings(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    model = sc.train(sc.labelled_findings(docs.filter("doc_id % 2 = 0")))
    rows = sc.scored(sc.candidates(sc.labelled_findings(docs.filter("doc_id % 2 = 1")), ("label",)), model).collect()
    assert sum((r.score >= sc.CUT) == (r.label == 1) for r in rows) >= 0.97 * len(rows)


def test_context_ends_at_the_next_candidate(spark):
    docs = spark.createDataFrame([(1, f"key a1b2c3d4e5f6g7 next {TOKEN}; end")], "doc_id long, text string")
    got = [(r.start, r.candidate, r.left, r.right) for r in sc.candidates(docs).orderBy("start").collect()]
    assert got == [(5, "a1b2c3d4e5f6g7", "key ", " next "), (25, TOKEN, " next ", "; end")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sc.scan_secrets(empty).count() == 0 and sc.redact(empty).count() == 0


def test_null_ids_change_nothing_and_without_a_model_nothing_is_masked(spark):
    texts = [f"see commit {TOKEN[k:] + TOKEN[:k]} in images/holiday-{2000 + k}-beach.png" for k in range(40)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert {r.text for r in sc.redact(docs).collect()} == set(texts)
    one_label = spark.createDataFrame([(f'token = "{TOKEN}"', 1)], "text string, label int")
    assert {r.text for r in sc.redact(docs, one_label).collect()} == set(texts)
    many = docs.union(docs).union(docs)
    assert sc.labelled_findings(many, ids=10_000).count() == sc.labelled_findings(docs, ids=10_000).count()

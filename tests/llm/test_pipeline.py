import re

import corpus_pipeline as cp
from annotary.llm import decontamination, language, near_dedup, secrets
from tests.conftest import SF_DIR
from tests.llm.test_near_dedup import brute_classes


def test_stages_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"]
    columns, rows = docs.columns, {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns and set(rows) <= set(before)
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert {k for k in before if not re.search(r"[^\W\d_]", before[k].text or "")} <= set(before) - set(rows)
            assert len(rows) >= 0.99 * len(before)
        if name == "near_dedup":
            assert set(rows) == set(brute_classes([(k, before[k].text) for k in sorted(before)]).values())
        if name == "decontamination":
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            dirty = {k for k, r in before.items() if any(i in " ".join(r.text.split()) for i in items)}
            assert dirty and not dirty & set(rows) and len(before) - len(rows) <= 1.2 * len(dirty) + 1
        if name == "secret_scan":
            assert set(rows) == set(before)
            masked = {k for k in rows if rows[k].text != before[k].text}
            assert masked == {k for k, r in before.items() if re.search(r'token = "[0-9a-f]{40}"', r.text)}
            assert all(rows[k].n_chars == len(rows[k].text) for k in masked)
        if name == "mixing":
            assert all(r.rate > 0 for r in rows.values()) and len(rows) >= 0.8 * len(before)


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the of and to in is was " * 30, "en", "s", 1), (2, "the of and to in is was " * 30, "en", "s", 1),
            (3, "12 !!", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert language.known_language(docs, language.learn(docs)).count() == 2
    assert near_dedup.keep_one(docs).count() == 4
    assert decontamination.decontaminate(docs, docs.selectExpr("doc_id AS item_id", "text").limit(0)).count() == 5
    assert secrets.redact(docs).count() == 5


def test_mixing_keeps_every_document(spark):
    sf_dir = SF_DIR.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = cp.mixed(spark, docs, sf_dir).collect()
    assert len(rows) == docs.count() and min(r.rate for r in rows) == cp.LEAST_RATE

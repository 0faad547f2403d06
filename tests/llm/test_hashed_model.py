import numpy as np

from annotary.llm import hashed_model as hm
from annotary.llm import text as tx
from tests.conftest import SF_DIR


def test_scores_equal_a_plain_sum_over_ngrams():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=hm.SLOTS + 1).astype(np.float32)
    for text in (b"", b"the cat, the dog", "é É 12ab!!".encode(), b"x " * 5000):
        hashes, _ = tx.tokens([text])
        slots = [int(h) % hm.SLOTS for h in hashes]
        pairs, whole = tx.windows(hashes, np.array([0, len(hashes)]), 2)
        slots += [int(h) % hm.SLOTS for h in pairs[whole]]
        values = {s: 1 + np.log(slots.count(s)) for s in set(slots)}
        norm = np.sqrt(sum(v * v for v in values.values())) or 1
        z = sum(v / norm * weights[s] for s, v in values.items()) + weights[-1]
        assert abs(hm.scores([text], weights)[0] - 1 / (1 + np.exp(-z))) < 1e-6


def test_learns_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")
    rows = hm.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    poor = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > p for g in good for p in poor]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_edge_rows(spark):
    rows = [(1, "good text here"), (2, "bad !! ###"), (3, None), (None, ""), (1, "good text here"), (4, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS predicted")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 1), (9, None)], "doc_id long, quality int")
    got = hm.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r._predicted in (0, 1) and r.predicted == "x" for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = hm.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert hm.score_quality(docs.limit(0), labels).count() == 0


def test_copies_reach_the_driver_once(spark):
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "'one and the same text' AS text", "1 AS label")
    assert len(hm.packed(hm.sampled(docs, 4000))) == 1

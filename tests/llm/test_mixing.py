import numpy as np

from annotary.llm import mixing as mx
from tests.conftest import SF_DIR


def test_rates_meet_the_targets_like_a_brute_force_descent(spark):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 300, 200)
    shares = rng.dirichlet([1, 1, 1, 1], 200)
    narrow = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, shares)], "tokens long, shares array<double>")
    targets = [0.2, 0.3, 0.25, 0.25]
    pulls = mx.fit_rates(narrow.repartition(3), targets)
    got = mx.rates(tokens, shares, pulls)
    rate, a = np.ones(200), (tokens[:, None] * shares).T
    wanted = np.array(targets) * tokens.sum()
    for _ in range(len(pulls)):
        rate = np.maximum(0, rate - a.T @ np.linalg.solve(a @ a.T, a @ rate - wanted))
    assert np.allclose(got, rate, atol=1e-6) and (got >= 0).all()
    assert np.allclose(a @ got, wanted, rtol=1e-4)


def test_unreachable_targets_and_empty_tables(spark):
    narrow = spark.createDataFrame([(10, [1.0, 0.0]), (0, [0.5, 0.5])], "tokens long, shares array<double>")
    got = mx.rates(np.array([10, 0]), np.array([[1.0, 0.0], [0.5, 0.5]]), mx.fit_rates(narrow, [0.5, 0.5]))
    assert np.allclose(got, [0.5, 1.0])
    assert mx.fit_rates(narrow.limit(0), [0.5, 0.5]) == []


def test_soft_mix_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = mx.soft_mix(docs, labels).collect()
    total = sum(r.tokens for r in rows)
    assert len(rows) == docs.count()
    far = {}
    for name, rate in (("before", lambda r: 1.0), ("after", lambda r: r.rate)):
        met = {d: sum(rate(r) * r.tokens * r[f"p_{d}"] for r in rows) / total for d in mx.DOMAINS}
        far[name] = sum(abs(met[d] - mx.TARGETS[d]) for d in mx.DOMAINS)
    assert far["after"] < 0.7 * far["before"]


def test_edge_rows(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (None, "a b c", 9.0), (3, "a b c", None), (3, "a b c", None), (4, "w " * 200_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = mx.soft_mix(docs, known).collect()
        assert len(got) == len(rows) and all(r._rate >= 0 for r in got)
        assert {r._rate for r in got if r.tokens == 0} == {1.0}
        assert [r.tokens for r in got if r.doc_id == 4] == [200_000]
    assert mx.soft_mix(docs.limit(0), labels).count() == 0


def test_sharp_shares_meet_reachable_targets(spark):
    rng = np.random.default_rng(2)
    tokens = rng.lognormal(5, 1.2, 3000).astype(int)
    logits = rng.normal(0, 3, (3000, 4))
    logits[np.arange(3000), rng.choice(4, 3000, p=[0.2, 0.65, 0.05, 0.1])] += 9
    shares = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    narrow = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, shares)], "tokens long, shares array<double>")
    for floor in (0.0, 0.01):
        pulls, expected, wanted = mx.fitted(narrow.repartition(3), [mx.TARGETS[d] for d in mx.DOMAINS], floor)
        rate = mx.rates(tokens, shares, pulls, floor)
        assert (rate == floor).any() and rate.min() == floor and len(pulls) < 40
        assert np.abs((rate * tokens) @ shares - wanted).max() <= 2e-6 * tokens.sum()
        assert np.allclose((rate * tokens) @ shares, expected)


def test_soft_mix_meets_the_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    rows = mx.soft_mix(docs, spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")).collect()
    total = sum(r.tokens for r in rows)
    met = {d: sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) / total for d in mx.DOMAINS}
    print("met", met, "rate 0:", sum(r.rate == 0 for r in rows), "of", len(rows))
    assert all(abs(met[d] - mx.TARGETS[d]) < 1e-4 for d in mx.DOMAINS)

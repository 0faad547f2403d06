import numpy as np

from annotary.llm import whitening
from tests.conftest import SF_DIR


def expected(vectors):
    x = np.array([np.floor(256 * np.asarray(v, float)).astype(np.int64) for v in vectors])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov((fit - total / n).T, bias=True))
    return x, n, total, values[::-1], axes[:, ::-1]


def test_equals_a_dense_whitening(spark):
    rows = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/embeddings.parquet")
    rows = rows.union(rows.limit(30))  # copies change no covariance
    got = whitening.whiten(rows).toPandas()
    table = rows.dropDuplicates(["vec_id"]).toPandas()
    x, n, total, values, axes = expected(table.embedding)
    assert len(got) == 4 * rows.count() and (got.n == n).all() and got.identity_error.iloc[0] < 1e-9
    for k in range(4):
        part = got[got.component == k + 1].drop_duplicates("vec_id").set_index("vec_id").loc[table.vec_id]
        want = (x - total / n) @ axes[:, k] / np.sqrt(values[k])
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-9
        assert abs(part.explained.iloc[0] - values[k] / values.sum()) < 1e-12
        assert (part.deviation.to_numpy() == ((n * x - total) ** 2).sum(1)).all()


def test_many_blocks_and_cuts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 2)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(100, 3)) @ np.diag([3.0, 1.0, 0.1])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows).toPandas()
    x, n, total, values, axes = expected(vectors)
    assert sorted(set(got.component)) == [1, 2, 3]
    for k in range(3):
        part = got[got.component == k + 1].set_index("vec_id").loc[range(100)].whitened
        want = (x - total / n) @ axes[:, k] / np.sqrt(values[k])
        assert min(np.abs(part - want).max(), np.abs(part + want).max()) < 1e-9


def test_edge_rows(spark):
    rows = [
        (1, [1.0, 2.0]),
        (1, [1.0, 2.0]),
        (2, None),
        (3, [None, 1.0]),
        (4, [float("nan"), 1.0]),
        (5, [float("inf"), 0.0]),
        (None, [0.5]),
        (6, []),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS n", "1 AS component")
    got = whitening.whiten(table).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (6, 1), (6, 2)]
    assert {r.n for r in got} == {3} and all(r.whitened is not None for r in got)  # short vectors are filled with zeros
    alone = whitening.whiten(table.filter("vec_id = 1")).collect()
    assert len(alone) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in alone)
    huge = spark.createDataFrame([(1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
    for none in (table.limit(0), table.filter("vec_id = 6"), table.filter("vec_id = 2")):
        assert whitening.whiten(none).collect() == []


def test_sums_of_large_entries_are_exact(spark):
    big = 2**62
    fit = spark.createDataFrame([([big, -big, -1],), ([big, -big, 5],), ([big + 1, -big - 3, -9],)], "x array<long>")
    assert whitening.vector_sums(fit, 3) == (3, [3 * big + 1, -3 * big - 3, -5])


def test_blocks_are_kept_while_they_are_multiplied_and_no_longer(spark, monkeypatch):
    seen, scatter = [], whitening.scatter
    level = lambda blocks: blocks._java_matrix_wrapper._java_model.blocks().getStorageLevel()
    monkeypatch.setattr(whitening, "scatter", lambda blocks: (seen.append((blocks, level(blocks).useMemory())), scatter(blocks))[1])
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(70)], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows)
    assert [kept for _, kept in seen] == [True, True] and got.count() == 140
    assert not any(level(blocks).useMemory() or level(blocks).useDisk() for blocks, _ in seen)

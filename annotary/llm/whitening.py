"""Whitening of embeddings with MLlib's distributed block matrices (operator 12).

The distinct vectors, as integers, get dense row numbers and become centred rows
of an ``IndexedRowMatrix``, then blocks of a ``BlockMatrix``. Its transpose times
itself is the scatter matrix; the middle dimension is cut, so that no task gets
more than a few blocks and only d x d numbers reach the driver. Eigenvectors are
found there, and one more block product projects all rows. Rows stay in the JVM.
"""

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm.shared import written
from annotary.operators.ordered import running_totals

BLOCK_ROWS = 1024
SPLIT_BLOCKS = 8  # blocks of the long dimension that meet in one task of a product
SCALE = 256
_EXACT = "decimal(38,0)"
_LOW = 32


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, x): x = floor(scale * entry) of rows whose vector has neither null nor non-finite entries.

    Shorter vectors are filled with zeros up to the longest. Entries beyond
    the range of a long become its largest or smallest value.
    """
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    )
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(0).cast("long"))
    found = rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(f"`{key}`").alias("key"), x.alias("x"))
    found = written(found, "vectors")
    sizes = found.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] != sizes[1]:
        fill = F.array_repeat(F.lit(0).cast("long"), F.lit(sizes[1]) - F.size("x"))
        found = found.withColumn("x", F.concat("x", fill))
    return found


def vector_sums(fit: DataFrame, size: int):
    """(number of rows, exact sums of the entries of x); high and low halves are summed as longs, for up to 2**31 rows."""
    entries = [F.get("x", F.lit(k)) for k in range(size)]
    halves = [half for x in entries for half in (F.shiftright(x, _LOW), x.bitwiseAND(F.lit((1 << _LOW) - 1)))]
    n, *sums = fit.agg(F.count(F.lit(1)), *[F.sum(half) for half in halves]).first()
    return n, [(high << _LOW) + low for high, low in zip(sums[::2], sums[1::2])]


def centred_blocks(fit: DataFrame, mean: np.ndarray) -> BlockMatrix:
    """The rows (row, x) minus ``mean``, as a block matrix of one column of blocks."""
    centred = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda c, m: c.cast("double") - m)
    rows = fit.select(F.col("row").alias("index"), array_to_vector(centred).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector")).toBlockMatrix(BLOCK_ROWS, len(mean))


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times the matrix, on the driver."""
    splits = max(1, -(-blocks.numRowBlocks // SPLIT_BLOCKS))
    mine = blocks._java_matrix_wrapper._java_model
    # PySpark's multiply() does not take the number of cuts of the middle dimension, Scala's does
    product = mine.transpose().multiply(mine, splits)
    return np.asarray(BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray())


def local_blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as one block."""
    rows, columns = matrix.shape
    block = DenseMatrix(rows, columns, matrix.ravel(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), rows, columns)


def principal(covariance: np.ndarray, most: int):
    """Eigenvalues, falling, and unit eigenvectors (columns) whose largest entry is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[lead, np.arange(len(values))] < 0, -1.0, 1.0)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row for each sound vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Covariances are over the distinct integer vectors, so copies change
    nothing, and every copy (and every row of a repeated or null key) gets
    its own result rows. Ties of eigenvalues are in the order of the solver.
    A component without variance has a null ``whitened``; ``explained`` is null
    if there is no variance at all, ``identity_error`` if no component has
    any. ``deviation`` is exact, or null beyond the range of a long. An
    empty table, or one without sound vectors or with vectors of no entries only, gives no rows. Other columns
    are not read, whatever their names.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, key, vector)
    name = key
    out = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = running_totals(vectors.select("x").distinct(), [F.col("x")], position="place")
    fit = written(fit.select((F.col("place") - 1).alias("row"), "x"), "fit")
    size = (vectors.select(F.size("x")).first() or [0])[0]
    if size == 0:
        empty = spark.createDataFrame([], out).withColumn("key", F.lit(None).cast(vectors.schema["key"].dataType))
        return empty.withColumnRenamed("key", name)
    n, sums = vector_sums(fit, size)

    # each product reads the blocks of both its sides, so they are built once
    blocks = centred_blocks(fit, np.array([s / n for s in sums])).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(blocks) / n
    values, axes = principal(covariance, components)
    trace = float(np.trace(covariance))
    live = values > size * np.finfo(float).eps * max(values[0], 0.0)
    shrink = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    projected = blocks.multiply(local_blocks(spark, axes * shrink)).persist(StorageLevel.MEMORY_AND_DISK)
    spread = scatter(projected)[np.ix_(live, live)] / n
    error = float(np.abs(spread - np.eye(int(live.sum()))).max()) if live.any() else None

    table = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    table = MLUtils.convertVectorColumnsToML(table, "vector").select(
        F.col("index").alias("row"), vector_to_array("vector").alias("y")
    )
    table = written(table, "projected")
    for matrix in (projected, blocks):
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    apart = F.zip_with(
        "x",
        F.array(*[F.lit(str(s)).cast(_EXACT) for s in sums]),
        lambda c, s: F.try_subtract(F.try_multiply(c.cast("decimal(20,0)"), F.lit(n).cast("decimal(18,0)")).cast(_EXACT), s),
    )
    square = F.aggregate(
        apart, F.lit(0).cast(_EXACT), lambda sum_, d: F.try_add(sum_, F.try_multiply(d, d)).try_cast(_EXACT)
    )
    table = table.join(fit.select("row", "x", square.try_cast("bigint").alias("deviation")), "row").drop("row")
    facts = F.array(
        *[
            F.struct(F.lit(k + 1).alias("component"), F.lit(bool(live[k])).alias("live"), F.lit(float(v / trace) if trace else None).cast("double").alias("explained"))
            for k, v in enumerate(values)
        ]
    )
    return (
        vectors.join(table, "x")
        .select("key", "deviation", "y", F.inline(facts))
        .select(
            F.col("key").alias(name),
            "component",
            F.lit(n).cast("long").alias("n"),
            "deviation",
            F.when(F.col("live"), F.get("y", F.col("component") - 1)).alias("whitened"),
            "explained",
            F.lit(error).cast("double").alias("identity_error"),
        )
    )

"""Rings measured in batches against the expressions of ``geometry``."""

import math
import random

from pyspark.sql import functions as F

from annotary.functions import geometry as g
from annotary.functions.measures import ring_measures
from annotary.operators import records


def _polygons():
    rng = random.Random(7)
    ring = lambda n: [rng.uniform(-1e3, 1e3) for _ in range(n)]
    odd = [
        None, [], [None], [[]], [[1.0, 1.0, 2.0, 2.0]], [[None, 0.0, 1.0, 0.0, 1.0, 1.0]],
        [[0.0, 0.0, math.nan, 0.0, 1.0, 1.0], [0.0, 0.0, 9.0, 0.0, 9.0, 9.0]],
        [[3.0, 3.0, 3.0, 3.0, 3.0, 3.0], None, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0]], [[0.0, 0.0, math.inf, 0.0, 1.0, 1.0]],
    ]
    return odd + [[ring(2 * rng.randint(0, 40)) for _ in range(rng.randint(0, 4))] for _ in range(200)]


def test_measures_equal_the_expressions(spark):
    rows = spark.createDataFrame(list(enumerate(_polygons())), "id int, polygon array<array<double>>").repartition(3)
    one = F.transform("polygon", lambda r: F.struct(g.ring_area(r).alias("area"), g.extent(r).alias("extent")))
    both = rows.select(F.coalesce(one, F.expr("array()")).alias("a"), ring_measures("polygon").alias("b"))
    assert all(repr(r["a"]) == repr(r["b"]) for r in both.collect())


def test_cleaning_measures_in_batches(spark):
    rows = spark.createDataFrame(list(enumerate(_polygons())), "id int, polygon array<array<double>>")
    cleaned = records.clean_instances(rows)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    good = F.filter(F.coalesce("polygon", F.expr("array()")), lambda r: (F.size(r) >= 6) & (g.ring_area(r) > 0))
    wanted = {
        r["id"]: r
        for r in rows.withColumn("good", good)
        .select("id", "good", F.size("good").alias("n"), g.rings_extent("good").alias("extent"), F.aggregate(
            F.transform("good", g.ring_area), F.lit(0.0), lambda a, v: a + v).alias("area"),
            (F.coalesce(F.size("polygon"), F.lit(0)) - F.size("good")).alias("lost"))
        .collect()
    }
    for r in cleaned.collect():
        w = wanted[r["id"]]
        assert (repr(r["polygon"]), repr(r["extent"]), repr(r["area"]), r["dropped"], r["n_degenerate"]) == (
            repr(w["good"]), repr(w["extent"]), repr(w["area"]), w["n"] == 0, w["lost"])


def test_boxes_are_not_moved_through_the_join(spark):
    from annotary.plans import catalog
    from tests.conftest import SF_DIR

    plan = catalog.load()["clean_polygons"].run(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner"):]
    assert "bbox" not in below and "extent" in below

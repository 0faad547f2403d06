import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotary.operators import instances as inst
from annotary.operators import masks, ordered
from annotary.operators import scored as m


def labelled(spark, target, pred):
    return spark.createDataFrame(list(zip(target, pred)), "target int, pred int")


def scored(spark, rows):
    return spark.createDataFrame(rows, "target int, probs array<double>")


def test_confusion_iou_dice(spark):
    table = m.confusion(labelled(spark, [0, 1, 1, 1], [0, 1, 0, 1]), 2)
    assert {(r["target"], r["pred"]): r["n"] for r in table.collect()} == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    scores = {r["class"]: r for r in m.class_scores(table).collect()}
    assert scores[0]["iou"] == 0.5 and scores[1]["iou"] == pytest.approx(2 / 3)
    assert scores[0]["dice"] == pytest.approx(2 / 3) and scores[1]["dice"] == pytest.approx(0.8)
    means = m.mean_iou(m.class_scores(table)).first()
    assert means["mean_iou"] == pytest.approx(7 / 12) and means["mean_iou_damage"] == pytest.approx(2 / 3)


def test_absent_class_is_undefined(spark):
    cells = [(0, 0, 10), (1, 0, 2), (1, 1, 8)]
    table = m.complete_grid(spark.createDataFrame(cells, "target int, pred int, n long"), 3)
    scores = {r["class"]: r for r in m.class_scores(table).collect()}
    assert scores[2]["iou"] is None and scores[2]["dice"] is None
    assert m.mean_iou(m.class_scores(table)).first()["mean_iou"] == pytest.approx((10 / 12 + 8 / 10) / 2)
    empty = m.confusion(labelled(spark, [0], [0]).filter("target > 5"), 2)
    assert tuple(m.mean_iou(m.class_scores(empty)).first()) == (None, 0.0)


def test_out_of_range_class_fails(spark):
    with pytest.raises(Exception, match="out of range"):
        m.confusion(labelled(spark, [0, 3], [0, 0]), 3).collect()
    with pytest.raises(Exception, match="out of range"):
        m.score_cube(scored(spark, [(2, [0.5, 0.5])]), 2).collect()
    with pytest.raises(ValueError):
        m.score_cube(scored(spark, [(0, [0.5, 0.5])]), 2, 0)


CALIBRATION = [(1, [0.25, 0.75]), (0, [0.25, 0.75]), (1, [0.75, 0.25]), (0, [0.75, 0.25])]


def test_ece_and_brier(spark):
    cube = m.score_cube(scored(spark, CALIBRATION), 2, 10)
    assert m.expected_calibration_error(m.reliability_bins(cube)).first()["ece"] == pytest.approx(0.25)
    assert m.brier_score(cube).first()["brier_score"] == pytest.approx(0.625)
    none = m.score_cube(scored(spark, CALIBRATION).filter("target > 5"), 2)
    assert m.expected_calibration_error(m.reliability_bins(none)).first()["ece"] is None
    assert m.brier_score(none).first()["brier_score"] is None


def test_full_confidence_falls_in_last_bin(spark):
    bins = m.reliability_bins(m.score_cube(scored(spark, [(0, [1.0, 0.0])]), 2)).collect()
    assert [(r["bin"], r["accuracy"]) for r in bins] == [(14, 1.0)]


def test_losses(spark):
    cube = m.score_cube(scored(spark, CALIBRATION), 2)
    values = m.losses(cube, 2).first()
    assert values["cross_entropy"] == pytest.approx(-np.mean(np.log([0.75, 0.25, 0.25, 0.75])))
    # both classes: 2 * 1.0 / (2 + 2)
    assert values["dice_loss"] == pytest.approx(0.5, abs=1e-6)
    report = m.evaluation_report(scored(spark, CALIBRATION), 2, 10).first()
    assert report["ece"] == pytest.approx(0.25) and report["loss"] == pytest.approx(values["loss"])


def test_partial_tables_add_up(spark):
    a, b = labelled(spark, [0, 1], [1, 1]), labelled(spark, [1, 0], [0, 0])
    merged = m.merge_confusions(m.confusion(a, 2), m.confusion(b, 2))
    whole = m.confusion(a.unionByName(b), 2)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


# -- masks -----------------------------------------------------------------------

RUNS = "image_id string, class int, instance_id string, y int, x0 int, x1 int"


def block(image, name, y0, y1, x0, x1, cls=1):
    return [(image, cls, name, y, x0, x1) for y in range(y0, y1)]


def test_pair_iou(spark):
    pred = spark.createDataFrame(block("a", "p", 0, 2, 0, 2), RUNS)
    true = spark.createDataFrame(block("a", "t", 0, 2, 0, 3) + block("a", "far", 8, 9, 0, 3), RUNS)
    pairs = inst.overlapping_pairs(pred, true).collect()
    assert [(r["true_id"], r["iou"]) for r in pairs] == [("t", 4 / 6)]
    asked = spark.createDataFrame(
        [("a", 1, "p", "t"), ("a", 1, "p", "far"), ("b", 1, "x", "y")],
        "image_id string, class int, pred_id string, true_id string",
    )
    got = {r["true_id"]: r["iou"] for r in inst.iou_of_pairs(asked, pred, true).collect()}
    assert got == {"t": 4 / 6, "far": 0.0, "y": 0.0}
    wide_p = spark.createDataFrame(block("w", "p", 0, 1, 10, 200), RUNS)
    wide_t = spark.createDataFrame(block("w", "t", 0, 1, 100, 300), RUNS)
    assert inst.overlapping_pairs(wide_p, wide_t).first()["intersection"] == 100


def greedy(preds, ious, t):
    """Walk predictions by falling score, each taking its best free truth."""
    hits, used = set(), set()
    for pid, _ in sorted(preds, key=lambda p: (-p[1], p[0])):
        free = [(v, tid) for (q, tid), v in ious.items() if q == pid and tid not in used]
        if free:
            v, tid = min(free, key=lambda e: (-e[0], e[1]))
            if v >= t:
                used.add(tid)
                hits.add(pid)
    return hits


@pytest.mark.parametrize("match", [inst.greedy_matches, inst.greedy_matches_in_rounds])
def test_greedy_matching_equals_walk(spark, match):
    rng = np.random.default_rng(0)
    preds, pairs, expected = [], [], {}
    for image in ("a", "b", "c"):
        mine = [(f"p{k}", float(rng.integers(1, 5)) / 4) for k in range(12)]
        ious = {(p, f"t{j}"): float(rng.integers(40, 100)) / 100 for p, _ in mine for j in range(8) if rng.random() < 0.5}
        preds += [(image, 1, p, s) for p, s in mine]
        pairs += [(image, 1, p, t, v) for (p, t), v in ious.items()]
        for t in inst.IOU_THRESHOLDS:
            expected[image, t] = greedy(mine, ious, t)
    p = spark.createDataFrame(preds, "image_id string, class int, pred_id string, score double")
    e = spark.createDataFrame(pairs, "image_id string, class int, pred_id string, true_id string, iou double")
    table = inst.match_table(match(p, e)).collect()
    assert len(table) == len(preds) * 10
    got = {}
    for r in table:
        if r["is_tp"]:
            got.setdefault((r["image_id"], r["threshold"]), set()).add(r["pred_id"])
    assert got == {k: v for k, v in expected.items() if v}


def test_average_precision(spark):
    pred = spark.createDataFrame(block("a", "p", 0, 2, 0, 2) + block("b", "q", 5, 7, 5, 7), RUNS)
    true = spark.createDataFrame(
        block("a", "t", 0, 2, 0, 2) + block("b", "u", 0, 2, 0, 2) + block("c", "never", 0, 1, 0, 1, cls=2), RUNS
    )
    scores = spark.createDataFrame(
        [("a", 1, "p", 0.9), ("b", 1, "q", 0.8)], "image_id string, class int, pred_id string, score double"
    )
    matches = inst.greedy_matches(scores, inst.overlapping_pairs(pred, true))
    truths = true.select("image_id", "class", "instance_id").distinct()
    ap = inst.average_precision(matches, truths, 4)
    got = {(r["class"], r["threshold"]): r["ap"] for r in ap.collect()}
    assert got[1, 0.5] == pytest.approx(51 / 101)
    assert got[2, 0.5] == 0.0 and got[3, 0.5] is None and (0, 0.5) not in got
    total = inst.mean_average_precision(ap).first()
    assert total["map_50"] == pytest.approx(51 / 202) and total["map"] == pytest.approx(51 / 202)


def flood(grid):
    """Raster-first pixel of the component of every set pixel."""
    label = {}
    for y, x in zip(*np.nonzero(grid)):
        if (y, x) in label:
            continue
        stack, label[y, x] = [(y, x)], (y, x)
        while stack:
            cy, cx = stack.pop()
            for ny in range(cy - 1, cy + 2):
                for nx in range(cx - 1, cx + 2):
                    if 0 <= ny < grid.shape[0] and 0 <= nx < grid.shape[1] and grid[ny, nx] and (ny, nx) not in label:
                        label[ny, nx] = (y, x)
                        stack.append((ny, nx))
    return {k: (int(v[0]) << 31) + int(v[1]) for k, v in label.items()}


@pytest.mark.parametrize("tile", [512, 7])
def test_components_equal_flood_fill(spark, tile):
    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for image, density in (("sparse", 0.2), ("dense", 0.45)):
        grid = rng.random((30, 33)) < density
        rows += [(image, 1, int(y), int(x), int(x) + 1) for y, x in zip(*np.nonzero(grid))]
        expected |= {(image, int(y), int(x)): c for (y, x), c in flood(grid).items()}
    runs = spark.createDataFrame(rows, "image_id string, class int, y int, x0 int, x1 int")
    got = {}
    for r in masks.components(runs, tile).collect():
        got |= {(r["image_id"], r["y"], x): r["component"] for x in range(r["x0"], r["x1"])}
    assert got == expected


def polygons(spark, rows):
    return spark.createDataFrame(
        rows, "image_id string, class int, instance_id string, polygon array<array<double>>, width int, height int"
    )


def pixels(runs):
    return {(r["image_id"], r["instance_id"], r["y"], x) for r in runs.collect() for x in range(r["x0"], r["x1"])}


def test_polygon_fill(spark):
    square = [1.0, 1.0, 5.0, 1.0, 5.0, 4.0, 1.0, 4.0]
    other = [3.0, 2.0, 8.0, 2.0, 8.0, 5.0, 3.0, 5.0]
    runs = masks.polygon_runs(
        polygons(spark, [("a", 1, "one", [square], 20, 20), ("a", 1, "two", [square, other], 20, 20), ("a", 1, "cut", [other], 6, 3)])
    )
    first = {(y, x) for y in range(1, 4) for x in range(1, 5)}
    second = {(y, x) for y in range(2, 5) for x in range(3, 8)}
    got = pixels(runs)
    assert {(y, x) for _, i, y, x in got if i == "one"} == first
    assert {(y, x) for _, i, y, x in got if i == "two"} == first | second
    assert {(y, x) for _, i, y, x in got if i == "cut"} == {(y, x) for y, x in second if y < 3 and x < 6}
    areas = {r["instance_id"]: r["area"] for r in inst.mask_areas(runs).collect()}
    assert areas["two"] == len(first | second)


def test_merge_prefers_higher_category(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for k in range(60):
        y, x0, category = int(rng.integers(0, 4)), int(rng.integers(0, 120)), int(rng.integers(1, 6))
        x1 = x0 + int(rng.integers(1, 70))
        rows.append(("a", 1 + category % 2, y, x0, x1, category))
        for x in range(x0, x1):
            expected[y, x] = max(expected.get((y, x), (0, 0)), (category, 1 + category % 2))
    runs = spark.createDataFrame(rows, "image_id string, class int, y int, x0 int, x1 int, category_id int")
    got = {}
    for r in masks.merge_masks(runs).collect():
        for x in range(r["x0"], r["x1"]):
            assert (r["y"], x) not in got
            got[r["y"], x] = r["class"]
    assert got == {k: v[1] for k, v in expected.items()}


def test_predicted_instances(spark):
    rows = [("a", y, x, [0.2, 0.8] if (y < 2 and x < 2) or (y > 3 and x > 3) else [0.9, 0.1]) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, probs array<double>")
    found, runs = masks.predicted_instances(px)
    got = found.collect()
    assert sorted(r["n_pixels"] for r in got) == [4, 4] and all(r["score"] == pytest.approx(0.8) for r in got)
    assert runs.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == 8


def test_instance_evaluation_end_to_end(spark):
    from annotary.operators import taxonomy
    from annotary.plans import evaluation

    images = spark.createDataFrame([("a", 12, 10), ("b", 12, 10)], "image_id string, width int, height int")
    square = [1.0, 1.0, 5.0, 1.0, 5.0, 4.0, 1.0, 4.0]
    inst_rows = [("a", 0, "scratch", [square]), ("b", 0, "lamp_broken", [square])]
    annotated = spark.createDataFrame(inst_rows, "image_id string, pos int, canonical string, polygon array<array<double>>")
    canonical, _ = taxonomy.damage_taxonomy(spark)
    truth = evaluation.truth_runs(images, annotated, canonical=canonical)
    assert {r["class"] for r in truth.collect()} == {1, 2}

    def probs(image, y, x):
        hit = 1 <= y < 4 and 1 <= x < 5
        return [0.1, 0.2, 0.7] if hit and image == "a" else [0.8, 0.1, 0.1]

    px = spark.createDataFrame(
        [(i, y, x, probs(i, y, x)) for i in "ab" for y in range(10) for x in range(12)],
        "image_id string, y int, x int, probs array<double>",
    )
    ap, total = evaluation.evaluate_instances(px, truth, 3)
    got = {(r["class"], r["threshold"]): r["ap"] for r in ap.collect()}
    assert got[2, 0.95] == 1.0 and got[1, 0.5] == 0.0
    assert tuple(total.first()) == (0.5, 0.5)
    boxed = evaluation.truth_runs(images, annotated, size=24).collect()
    assert sum(r["x1"] - r["x0"] for r in boxed if r["image_id"] == "a") == 8 * 6


def test_losses_of_hopeless_rows(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0], [0.0, 900.0]), (0, [0.5, 0.5], [1.0, 1.0])], "target int, probs array<double>, logits array<double>")
    exact = entropy(rows)
    assert math.isclose(exact, (900 + math.log(2)) / 2)
    assert math.isclose(entropy(rows.drop("logits")), (708.3964185322641 + math.log(2)) / 2)


def entropy(rows):
    return m.losses(m.score_cube(rows, 2), 2).first()["cross_entropy"]


def test_far_vertices_and_overlapping_rings(spark):
    box = [2.0, 2.0, 6.0, 2.0, 6.0, 5.0, 2.0, 5.0]
    far = [-3e9, 1.0, 1e300, 1.0, 1e300, 3.0, -3e9, 3.0]
    df = spark.createDataFrame(
        [("a", 1, "0", [box, [v + 1 for v in box]], 20, 10), ("b", 1, "0", [far], 20, 10)],
        "image_id string, class int, instance_id string, polygon array<array<double>>, width int, height int",
    )
    runs = masks.polygon_runs(df).collect()
    pixels = {i: {(r["y"], x) for r in runs if r["image_id"] == i for x in range(r["x0"], r["x1"])} for i in "ab"}
    area = {i: sum(r["x1"] - r["x0"] for r in runs if r["image_id"] == i) for i in "ab"}
    assert pixels["a"] == {(y, x) for y in range(2, 5) for x in range(2, 6)} | {(y, x) for y in range(3, 6) for x in range(3, 7)}
    assert pixels["b"] == {(y, x) for y in (1, 2) for x in range(20)} and area == {i: len(pixels[i]) for i in "ab"}


def test_pairs_of_crossing_masks_move_masks_not_runs(spark):
    """Masks over several cells, beside zero and with holes, against counting pixels."""
    rng = np.random.default_rng(4)
    runs, pixels = {}, {}
    for side in ("p", "t"):
        runs[side], pixels[side] = [], {}
        for k in range(12):
            y0, x0 = (int(v) for v in rng.integers(-70, 120, 2))
            for y in range(y0, y0 + int(rng.integers(1, 90))):
                for x in (x0, x0 + 60):
                    x1 = x + int(rng.integers(1, 50))
                    runs[side].append(("i", 1, f"{side}{k}", y, x, x1))
                    pixels[side].setdefault(f"{side}{k}", set()).update((y, c) for c in range(x, x1))
    p, t = (spark.createDataFrame(runs[side], RUNS) for side in ("p", "t"))
    got = {(r["pred_id"], r["true_id"]): (r["intersection"], r["pred_area"], r["true_area"]) for r in inst.overlapping_pairs(p, t).collect()}
    wanted = {(a, b): (len(pixels["p"][a] & pixels["t"][b]), len(pixels["p"][a]), len(pixels["t"][b])) for a in pixels["p"] for b in pixels["t"]}
    assert got == {k: v for k, v in wanted.items() if v[0]}
    shape = "struct<image_id:string,class:int,instance_id:string,score:double,spans:array<struct<y:int,x0:int,x1:int>>>"
    rows = spark.createDataFrame([("i", 1, "m", 0.5, [(0, 0, 4)]), ("i", 1, "none", 0.5, [])], shape[7:-1])
    met = inst.overlapping_masks(rows, rows)
    assert [(r["pred_id"], r["intersection"], r["score"]) for r in met.collect()] == [("m", 4, 0.5)]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "Window" not in plan


def test_predicted_instances_evaluates_probabilities_once(spark, monkeypatch):
    from annotary.functions import scoring

    plans = []
    whole = masks.components

    def noted(runs, *args, **kwargs):
        plans.append(runs._jdf.queryExecution().optimizedPlan().toString())
        return whole(runs, *args, **kwargs)

    monkeypatch.setattr(masks, "components", noted)
    logits = spark.createDataFrame([("a", 0, 0, [0.0, 2.0, 1.0]), ("a", 0, 1, [0.0, 2.0, 1.0])], "image_id string, y int, x int, l array<double>")
    pixels = logits.filter("x >= 0").select("image_id", "y", "x", scoring.softmax("l", 3).alias("probs"))
    scores, _ = masks.predicted_instances(pixels, tile=4)
    assert [r["n_pixels"] for r in scores.collect()] == [2]
    assert not [line for line in plans[0].splitlines() if "Filter" in line and "EXP(" in line]


def shuffled(spark, run):
    """Bytes that ``run`` writes for shuffles."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_pairs_move_numbers_not_names(spark):
    from annotary.plans.catalog_masks import pair_iou

    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(spark, lambda: pair_iou(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < moved < 60 * lines, moved / lines


@pytest.mark.parametrize("match", [inst.greedy_matches, inst.greedy_matches_in_rounds])
def test_predictions_without_a_match_are_not_moved(spark, match):
    n = 20_000
    preds = spark.range(n).selectExpr("concat('i', id % 500) AS image_id", "1 AS class", "md5(string(id)) AS pred_id", "double(0.5) AS score").repartition(2)
    edge = spark.createDataFrame(
        [("i7", 1, hashlib.md5(b"7").hexdigest(), "t", 0.72), ("i8", 1, hashlib.md5(b"8").hexdigest(), "t", 0.9),
         ("i8", 1, hashlib.md5(b"508").hexdigest(), "t", 0.95)],
        "image_id string, class int, pred_id string, true_id string, iou double",
    ).withColumn("score", F.lit(0.5))
    preds.count()
    preds = spark.createDataFrame(preds.toPandas(), preds.schema)
    got = []
    moved = shuffled(spark, lambda: got.extend(match(preds, edge, [0.5, 0.7, 0.75]).collect()))
    assert moved < 10 * n
    assert len(got) == n and {r["pred_id"]: r["hit_thresholds"] for r in got if r["hit_thresholds"]} == {
        hashlib.md5(b"7").hexdigest(): [0.5, 0.7],
        **({hashlib.md5(b"508").hexdigest(): [0.5, 0.7, 0.75]} if hashlib.md5(b"508").hexdigest() < hashlib.md5(b"8").hexdigest() else
           {hashlib.md5(b"8").hexdigest(): [0.5, 0.7, 0.75]}),
    }


def test_only_true_positives_meet_a_window(spark):
    """Rows that ``where`` leaves out count for positions and are gone before any window."""
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 10 == 0).cast("long").alias("hit"))
    order = {"order_by": [F.col("id")], "sums": {"n": F.col("hit")}, "partition_by": ["k"], "position": "at"}
    every = ordered.running_totals(rows, **order).filter("hit > 0")
    some = ordered.running_totals(rows, **order, where=F.col("hit") > 0)
    assert sorted(every.collect()) == sorted(some.select(every.columns).collect())
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "hit" in line for line in plan[plan.index("Window") :].split("\n"))

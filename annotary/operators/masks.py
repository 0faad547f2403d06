"""Masks as run-length tables: polygon fill, merging, letterboxing, components.

A run ``(image_id, class, instance_id, y, x0, x1)`` covers pixels x0 .. x1-1
of row y. Runs of one instance never overlap.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.functions import geometry as g
from annotary.session import evaluate_once, pinned

TILE = 512
CELL_BITS = 32
_SPANS = "array<struct<x0:int,x1:int>>"
_ROW_BITS = 31  # a pixel id is y * 2^31 + x: ids order like a raster scan


def polygon_runs(instances: DataFrame) -> DataFrame:
    """Fill ``polygon`` (rings, united) inside ``width`` x ``height``.

    Pixel-centre scanlines with the even-odd rule per ring. Every edge lists
    the scanlines of the frame that it crosses; sorted by (row, x), two
    consecutive crossings of a ring bound one span. All of it happens inside
    the polygon's own row, in proportion to the crossings inside the frame,
    and nothing is shuffled. Spans of several rings, which may overlap, are
    united in place.
    """
    spans = F.flatten(F.transform(g.readable_rings("polygon"), lambda r: _ring_spans(r, F.col("width"), F.col("height"))))
    united = F.when(F.size("polygon") > 1, g.let(spans, _united)).otherwise(spans)
    return instances.select("image_id", "class", "instance_id", F.inline(united)).filter("x0 < x1")


def _ring_spans(ring, width, height):
    """Spans ``(y, x0, x1)`` of one ring inside the frame."""
    n = g.n_points(ring)

    def crossings(i):
        j = (i + 1) % n
        edge = F.struct(
            F.get(ring, 2 * i).alias("x1"),
            F.get(ring, 2 * i + 1).alias("y1"),
            F.get(ring, 2 * j).alias("x2"),
            F.get(ring, 2 * j + 1).alias("y2"),
        )
        return g.let(edge, lambda e: _edge_crossings(e, height))

    ordered = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), crossings)))

    def column(x):  # first pixel whose centre is at or beyond x, clipped while still a double
        return F.ceil(F.least(F.greatest(x - 0.5, F.lit(0.0)), width.cast("double"))).cast("int")

    def pair_up(cuts):
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(cuts) - 2, F.lit(2)),
            lambda k: F.struct(
                F.get(cuts, k)["y"].alias("y"),
                column(F.get(cuts, k)["x"]).alias("x0"),
                column(F.get(cuts, k + 1)["x"]).alias("x1"),
            ),
        )
        return F.when(F.size(cuts) >= 2, pairs).otherwise(F.expr("array()"))

    return g.let(ordered, pair_up)


def _edge_crossings(e, height):
    """``(y, x)`` where an edge passes the centre line y + 0.5 of a row of the frame."""
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    first = F.ceil(F.least(F.greatest(low - 0.5, F.lit(0.0)), height.cast("double"))).cast("int")
    last = F.ceil(F.least(F.greatest(high - 0.5, F.lit(0.0)), height.cast("double"))).cast("int") - 1
    return F.when(
        first <= last,
        F.transform(
            F.sequence(first, last),
            lambda y: F.struct(
                y.alias("y"),
                (e["x1"] + (y + F.lit(0.5) - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])).alias("x"),
            ),
        ),
    ).otherwise(F.expr("array()"))


def _united(spans):
    """Spans cut where earlier ones of their row already reach."""

    def add(state, s):
        reach = F.when(s["y"] == state["y"], state["reach"]).otherwise(0)
        x0 = F.greatest(s["x0"], reach)
        rest = F.struct(s["y"].alias("y"), x0.alias("x0"), s["x1"].alias("x1"))
        out = F.when(x0 < s["x1"], F.array_append(state["out"], rest)).otherwise(state["out"])
        return F.struct(s["y"].alias("y"), F.greatest(reach, s["x1"]).alias("reach"), out.alias("out"))

    none = F.expr("array()").cast("array<struct<y:int,x0:int,x1:int>>")
    start = F.struct(F.lit(-1).alias("y"), F.lit(0).alias("reach"), none.alias("out"))
    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["out"])


def merge_masks(runs: DataFrame, priority="category_id") -> DataFrame:
    """One class per pixel: the highest category wins an overlap.

    Runs become bit masks of 32-pixel cells. Masks of the same category unite
    by ``bit_or``, so neither pixels nor instances are ever
    listed; per cell the categories, at most the class vocabulary, then hide
    each other from the highest down. Instances of one category have one
    class, so which of them lies on top makes no difference.
    """
    # One exchange, by image row: every grouping below contains that key.
    cells = _with_bits(runs).repartition("image_id", "y")
    cells = cells.groupBy("image_id", "y", "cell", priority, "class").agg(F.bit_or("bits").alias("bits"))
    cell = Window.partitionBy("image_id", "y", "cell")
    above = F.bit_or("bits").over(
        cell.orderBy(F.col(priority).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    visible = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(above, F.lit(0).cast("long"))))
    shown = (
        cells.withColumn("bits", visible)
        .filter(F.col("bits") != 0)
        .groupBy("image_id", "y", "cell", "class")
        .agg(F.bit_or("bits").alias("bits"))
    )
    return _maximal(
        shown.withColumn("_run", F.explode(_bit_runs(F.col("bits")))).select(
            "image_id",
            "class",
            "y",
            (F.col("cell") * CELL_BITS + F.col("_run.x0")).alias("x0"),
            (F.col("cell") * CELL_BITS + F.col("_run.x1")).alias("x1"),
        )
    )


def _with_bits(runs: DataFrame) -> DataFrame:
    """Runs as ``(cell, bits)``: bit k stands for pixel cell * 32 + k."""
    cell = F.explode(
        F.sequence(
            F.floor(F.col("x0") / CELL_BITS).cast("int"),
            F.floor((F.col("x1") - 1) / CELL_BITS).cast("int"),
        )
    )

    def ones(n):  # the n lowest bits, n from 0 to 32
        return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1

    start = F.greatest(F.lit(0), F.col("x0") - F.col("cell") * CELL_BITS)
    stop = F.least(F.lit(CELL_BITS), F.col("x1") - F.col("cell") * CELL_BITS)
    return runs.withColumn("cell", cell).withColumn("bits", ones(stop) - ones(start)).drop("x0", "x1")


def _bit_runs(bits):
    """Runs of ones of a 32-bit mask, lowest first.

    Adding the lowest one-bit carries through the run it starts, which shows
    where that run ends; what the sum leaves standing is the rest.
    """
    runs = F.bit_count(bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", bits, F.lit(1)))))

    def place(one_bit):
        return F.bit_count(one_bit - 1)

    def peel(state, _):
        low = state["m"].bitwiseAND(-state["m"])
        carried = state["m"] + low
        end = carried.bitwiseAND(-carried)
        run = F.struct(place(low).cast("int").alias("x0"), place(end).cast("int").alias("x1"))
        return F.struct(
            state["m"].bitwiseAND(carried).alias("m"), F.array_append(state["runs"], run).alias("runs")
        )

    start = F.struct(bits.alias("m"), F.expr("array()").cast(_SPANS).alias("runs"))
    return F.aggregate(F.sequence(F.lit(1), runs), start, peel, lambda s: s["runs"])


def _maximal(runs: DataFrame) -> DataFrame:
    """Join runs of one class that touch, row by row (one image row per key)."""
    line = Window.partitionBy("image_id", "y", "class").orderBy("x0")
    fresh = F.coalesce(F.lag("x1").over(line) != F.col("x0"), F.lit(True))
    return (
        runs.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_run", F.sum("_fresh").over(line))
        .groupBy("image_id", "class", "y", "_run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_run")
    )


def pixels_to_runs(pixels: DataFrame, keys, total: str) -> DataFrame:
    """Distinct pixels to maximal runs with the sum of ``total``. A window holds one image row at most."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        pixels.withColumn("_island", F.col("x") - F.row_number().over(line))
        .groupBy(*keys, "y", "_island")
        .agg(F.min("x").alias("x0"), (F.max("x") + 1).cast("int").alias("x1"), F.sum(total).alias(total))
        .drop("_island")
    )


def letterbox_runs(runs: DataFrame, size: int) -> DataFrame:
    """Map runs of a ``width`` x ``height`` image onto the square canvas.

    Nearest-neighbour: target pixel d shows source pixel
    floor((2d + 1) * source / (2 * target)). Solved for d with whole numbers,
    a source run becomes a target run directly, no pixel is expanded.
    """
    boxed = evaluate_once(runs, _box=g.letterbox("width", "height", size))
    new_w, new_h = F.col("_box.new_w").cast("long"), F.col("_box.new_h").cast("long")
    width, height = F.col("width").cast("long"), F.col("height").cast("long")

    def first_target(source, old, new):
        # smallest d with (2d + 1) * old >= 2 * new * source
        top = 2 * new * source - old
        return F.greatest(F.lit(0).cast("long"), _ceil_div(top, 2 * old))

    x0 = first_target(F.col("x0"), width, new_w)
    x1 = first_target(F.col("x1"), width, new_w)
    y0 = first_target(F.col("y"), height, new_h)
    y1 = first_target(F.col("y") + 1, height, new_h)
    return (
        evaluate_once(boxed, _x0=x0, _x1=F.least(x1, new_w), _y0=y0, _y1=F.least(y1, new_h))
        .filter((F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1")))
        .withColumn("_y", F.explode(F.sequence(F.col("_y0"), F.col("_y1") - 1)))
        .select(
            "image_id",
            "class",
            "instance_id",
            (F.col("_y") + F.col("_box.top")).cast("int").alias("y"),
            (F.col("_x0") + F.col("_box.left")).cast("int").alias("x0"),
            (F.col("_x1") + F.col("_box.left")).cast("int").alias("x1"),
        )
    )


def _ceil_div(top, bottom):
    return ((top + F.pmod(-top, bottom)) / bottom).cast("long")


# -- connected components ------------------------------------------------------


def components(
    runs: DataFrame, tile: int = TILE, carry=()
) -> DataFrame:
    """8-connected components per (image, class): runs plus ``component``.

    The component id is its first pixel in raster order, ``y * 2^31 + x``,
    whatever the tile size. Images are cut into tiles, so one huge image is
    many small tasks; each tile is labelled on its own, and the few labels
    that meet across tile borders are united afterwards by distributed star
    contraction.
    Columns named in ``carry`` stay with their run.
    """
    carry = list(carry)
    cut = _cut_into_tiles(runs.select("image_id", "class", "y", "x0", "x1", *carry), tile)
    kept = "".join(f", `{c}` {runs.schema[c].dataType.simpleString()}" for c in carry)
    labelled = pinned(
        _map_whole_keys(
            cut,
            ["image_id", "class", "ty", "tx"],
            ["y", "x0"],
            _label_tiles,
            f"image_id string, class int, ty int, tx int, y int, x0 int, x1 int, label long{kept}",
        )
    )
    image = ["image_id", "class"]
    roots = star_contract(_border_edges(labelled, tile), image)
    return labelled.join(
        roots.withColumnRenamed("node", "label"), [*image, "label"], "left"
    ).select(*image, "y", "x0", "x1", *carry, F.coalesce("root", "label").alias("component"))


def _map_whole_keys(df: DataFrame, keys, order, fn, schema) -> DataFrame:
    """Apply ``fn`` to sorted Arrow batches that never cut a key in two.

    Cheaper than one call per key where keys are many and small. At most one
    batch and one key are held, and callers bound the size of a key.
    """

    def batches(source):
        held = None
        for batch in source:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if batch.empty:
                continue
            same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            start = int(np.argmax(same))
            held = batch.iloc[start:]
            if start:
                yield fn(batch.iloc[:start])
        if held is not None:
            yield fn(held)

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(batches, schema)
    )


def _cut_into_tiles(runs: DataFrame, tile: int) -> DataFrame:
    """Split runs at tile borders; every piece knows its tile."""
    return (
        runs.withColumn("ty", F.floor(F.col("y") / tile).cast("int"))
        .withColumn(
            "tx",
            F.explode(
                F.sequence(
                    F.floor(F.col("x0") / tile).cast("int"),
                    F.floor((F.col("x1") - 1) / tile).cast("int"),
                )
            ),
        )
        .withColumn("x0", F.greatest("x0", F.col("tx") * tile))
        .withColumn("x1", F.least("x1", (F.col("tx") + 1) * tile))
    )


def _find(parent, i):
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _group_starts(*columns):
    """Index of the first row of every run of equal rows."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[0] = True
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def _label_tiles(tiles: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the runs of whole tiles, each row against the one above."""
    keys = [tiles[c].to_numpy() for c in ("image_id", "class", "ty", "tx")]
    ys, x0s, x1s = (tiles[c].to_numpy() for c in ("y", "x0", "x1"))
    tile_no = np.zeros(len(tiles), dtype=np.int64)
    tile_no[_group_starts(*keys)[1:]] = 1
    tile_no = tile_no.cumsum()
    starts = _group_starts(tile_no, ys)
    ends = np.append(starts[1:], len(ys))
    follows = np.append(
        False, (tile_no[starts[1:]] == tile_no[starts[:-1]]) & (ys[starts[1:]] == ys[starts[:-1]] + 1)
    )
    left, right = x0s.tolist(), x1s.tolist()
    parent = list(range(len(tiles)))
    above = (0, 0)
    for lo, hi, adjacent in zip(starts.tolist(), ends.tolist(), follows.tolist()):
        for i in range(lo + 1, hi):
            if left[i] <= right[i - 1]:
                parent[i] = _find(parent, i - 1)
        if adjacent:
            i, j = above[0], lo
            while i < above[1] and j < hi:
                if left[i] <= right[j] and left[j] <= right[i]:  # a shared corner counts
                    a, b = _find(parent, i), _find(parent, j)
                    parent[max(a, b)] = min(a, b)
                if right[i] < right[j]:
                    i += 1
                else:
                    j += 1
        above = (lo, hi)
    # The smaller index always becomes the root, so it is the first in raster order.
    roots = np.array([_find(parent, i) for i in range(len(tiles))], dtype=np.int64)
    return tiles.assign(label=(ys[roots].astype(np.int64) << _ROW_BITS) + x0s[roots])


def _border_edges(labelled: DataFrame, tile: int) -> DataFrame:
    """Label pairs touching across a tile border.

    Only border runs take part, joined on the exact row and tile they can
    touch: at most tile / 2 runs share such a key.
    """
    image = ["image_id", "class"]
    right = (
        labelled.filter(F.col("x1") == (F.col("tx") + 1) * tile)
        .select(
            *image,
            F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"),
            F.col("x1").alias("x0"),
            F.col("label").alias("a"),
        )
    )
    left = labelled.filter(F.col("x0") == F.col("tx") * tile).select(
        *image, "y", "x0", F.col("label").alias("b")
    )
    sideways = right.join(left, [*image, "y", "x0"]).select(*image, "a", "b")

    bottom = labelled.filter(F.col("y") == (F.col("ty") + 1) * tile - 1).select(
        *image,
        (F.col("y") + 1).alias("y"),
        F.explode(
            F.sequence(
                F.floor((F.col("x0") - 1) / tile).cast("int"), F.floor(F.col("x1") / tile).cast("int")
            )
        ).alias("tx"),
        F.col("x0").alias("p0"),
        F.col("x1").alias("p1"),
        F.col("label").alias("a"),
    )
    top = labelled.filter(F.col("y") == F.col("ty") * tile).select(
        *image, "y", "tx", "x0", "x1", F.col("label").alias("b")
    )
    downwards = (
        bottom.join(top, [*image, "y", "tx"])
        .filter((F.col("p0") <= F.col("x1")) & (F.col("x0") <= F.col("p1")))
        .select(*image, "a", "b")
    )
    return sideways.unionByName(downwards).filter(F.col("a") != F.col("b")).distinct()


def star_contract(edges: DataFrame, keys) -> DataFrame:
    """Smallest reachable node per node, for edges ``(keys, a, b)``.

    Alternating large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): O(log^2 n) rounds, every round
    a grouped minimum and a join, each pinned so lineage stays short.
    """
    keys = list(keys)
    current = pinned(
        edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    previous = None
    while True:
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(lowest, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, [*keys, "u"])
            .select(*keys, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        current = pinned(small)
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == previous:
            return current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        previous = mark


def predicted_instances(scored_pixels: DataFrame, tile: int = TILE):
    """``(instances, runs)`` from scored pixels ``(image_id, y, x, probs)``.

    One instance per component of the argmax mask and positive class (not 0);
    its score is the mean probability of that class over its pixels.
    """
    from annotary.functions import scoring

    # the filter must not carry a copy of the expression behind ``probs``
    best = {"class": scoring.argmax("probs"), "p": scoring.confidence("probs")}
    classed = evaluate_once(scored_pixels.select("image_id", "y", "x", "probs"), **best).drop("probs").filter(F.col("class") > 0)
    # A tile border would cut a run and its sum, so runs end at borders from the start.
    classed = classed.withColumn("_tx", F.floor(F.col("x") / tile))
    runs = pixels_to_runs(classed, ["image_id", "class", "_tx"], "p").drop("_tx")
    found = components(runs, tile, carry=["p"])
    placed = found.withColumn("instance_id", F.format_string("%019d", F.col("component")))
    n_pixels = F.sum(F.col("x1") - F.col("x0"))
    scores = placed.groupBy("image_id", "class", "instance_id").agg(
        (F.sum("p") / n_pixels).alias("score"), n_pixels.alias("n_pixels")
    )
    return scores, placed.select("image_id", "class", "instance_id", "y", "x0", "x1")

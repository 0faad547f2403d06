"""Polygon geometry as column expressions.

A ring is a flat ``[x1, y1, x2, y2, ...]`` array of doubles.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def n_points(ring) -> Column:
    return F.floor(F.size(_col(ring)) / 2).cast("int")


def interleave(xs, ys) -> Column:
    """Zip two coordinate lists into a ring; unequal lengths raise."""
    xs, ys = _col(xs), _col(ys)
    zipped = F.flatten(
        F.transform(
            F.arrays_zip(xs.alias("x"), ys.alias("y")),
            lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")),
        )
    )
    # arrays_zip pads the shorter side silently, hence the explicit length test.
    return F.when(F.size(xs) == F.size(ys), zipped).otherwise(
        F.raise_error(
            F.concat(
                F.lit("coordinate lists differ in length: "),
                F.size(xs).cast("string"),
                F.lit(" and "),
                F.size(ys).cast("string"),
            )
        ).cast("array<double>")
    )


def flatten_points(points) -> Column:
    """``[[x, y], ...]`` to a ring."""
    return F.transform(F.flatten(_col(points)), lambda v: v.cast("double"))


def let(value, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), fn), 0)


def ring_area(ring) -> Column:
    """Absolute shoelace area; 0 below three points."""

    def shoelace(r):
        n = 2 * n_points(r)

        def cross(acc, i):
            x, y = F.get(r, i), F.get(r, i + 1)
            x_next, y_next = F.get(r, (i + 2) % n), F.get(r, (i + 3) % n)
            return acc + (x * y_next - x_next * y)

        # Short rings are never walked: sequence(0, -2) would count downwards.
        return F.when(
            n >= 6,
            F.abs(F.aggregate(F.sequence(F.lit(0), n - 2, F.lit(2)), F.lit(_ZERO), cross)) / 2,
        ).otherwise(F.lit(_ZERO))

    # Inside an array function a ring that is an expression, not a column,
    # would be built again for every vertex.
    return let(_col(ring), shoelace)


def ring_xs(ring) -> Column:
    return F.filter(_col(ring), lambda v, i: i % 2 == 0)


def ring_ys(ring) -> Column:
    return F.filter(_col(ring), lambda v, i: i % 2 == 1)


def extent(ring) -> Column:
    """``struct(x0, y0, x1, y1)``: the coordinate ranges of a ring."""
    split = F.struct(ring_xs(ring).alias("xs"), ring_ys(ring).alias("ys"))
    return let(
        split,
        lambda s: F.struct(
            F.array_min(s["xs"]).alias("x0"),
            F.array_min(s["ys"]).alias("y0"),
            F.array_max(s["xs"]).alias("x1"),
            F.array_max(s["ys"]).alias("y1"),
        ),
    )


def extent_bbox(box) -> Column:
    box = _col(box)
    return F.array(box["x0"], box["y0"], box["x1"] - box["x0"], box["y1"] - box["y0"])


def ring_bbox(ring) -> Column:
    """``[x, y, width, height]`` of one ring."""
    return let(extent(ring), extent_bbox)


def rings_extent(rings) -> Column:
    """Coordinate ranges over all rings (each of even length)."""
    return extent(F.flatten(_col(rings)))


def is_degenerate(ring) -> Column:
    """Fewer than three points or no area."""
    ring = _col(ring)
    return (F.size(ring) < 6) | (ring_area(ring) == 0)


def readable_rings(rings) -> Column:
    """Rings of at least three points, whatever their area."""
    return F.filter(_col(rings), lambda ring: F.size(ring) >= 6)


def extent_out_of_frame(box, width, height) -> Column:
    """No part of an extent touches the frame; unknown sizes never match."""
    box, width, height = _col(box), _col(width), _col(height)
    outside = (box["x0"] >= width) | (box["y0"] >= height) | (box["x1"] <= 0) | (box["y1"] <= 0)
    return F.coalesce(width.isNotNull() & height.isNotNull() & outside, F.lit(False))


def is_out_of_frame(ring, width, height) -> Column:
    return let(extent(ring), lambda box: extent_out_of_frame(box, width, height))


def measured(ring) -> Column:
    """``struct(ring, area, extent)`` of a ring, the inputs of all the tests."""
    return let(
        _col(ring),
        lambda r: F.struct(r.alias("ring"), ring_area(r).alias("area"), extent(r).alias("extent")),
    )


def letterbox(width, height, size) -> Column:
    """Fit a frame into a square canvas: ``struct(new_w, new_h, left, top)``.

    Half values round to even, so ``bround`` and not ``round``.
    """
    width, height = _col(width), _col(height)
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    new_w = F.greatest(F.lit(1), F.bround(width * scale).cast("int"))
    new_h = F.greatest(F.lit(1), F.bround(height * scale).cast("int"))
    # floor division: the padding is never negative, a side never exceeds size
    return F.struct(
        new_w.alias("new_w"),
        new_h.alias("new_h"),
        F.floor((F.lit(size) - new_w) / 2).cast("int").alias("left"),
        F.floor((F.lit(size) - new_h) / 2).cast("int").alias("top"),
    )

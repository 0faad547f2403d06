"""Rings measured in Arrow batches: the same areas and extents as in ``geometry``, a batch at a time.

The expressions of ``geometry`` walk a ring vertex by vertex inside array
functions, which Spark interprets; here all rings of a batch are measured at
once. Sums run in vertex order, so that areas are the same to the last bit.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary import schemas

_EXTENT = T.StructType([T.StructField(name, T.DoubleType()) for name in ("x0", "y0", "x1", "y1")])
_RING = T.StructType([T.StructField("area", T.DoubleType()), T.StructField("extent", _EXTENT)])
_POLYGON = T.StructType(
    [
        T.StructField("area", T.DoubleType()),
        T.StructField("good", T.ArrayType(T.BooleanType())),
        T.StructField("n_good", T.IntegerType()),
        T.StructField("extent", _EXTENT),
    ]
)


def _numbers(values):
    """Numbers and null mask of an array of doubles."""
    return values.fill_null(0.0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)


def _sizes(lists):
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sizes, items):
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), items)


def _ranges(owner, low, high, n):
    """Least ``low`` and largest ``high`` of each of ``n`` owners (sorted), NaN being the largest; and who has none."""
    least, most, none = np.zeros(n), np.zeros(n), np.ones(n, bool)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        at = owner[starts]
        least[at], most[at], none[at] = np.fmin.reduceat(low, starts), np.maximum.reduceat(high, starts), False
    return least, most, none


def _measure(rings):
    """Areas, their null mask and the extents (two times least, most and mask) of an array of rings."""
    n, sizes = len(rings), _sizes(rings)
    values, null = _numbers(rings.flatten())
    begin = np.cumsum(sizes) - sizes
    points = np.where(sizes >= 6, sizes // 2, 0)
    owner = np.repeat(np.arange(n), points)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(points) - points, points)
    at = begin[owner] + 2 * place
    following = np.where(place + 1 == points[owner], begin[owner], at + 2)
    with np.errstate(all="ignore"):
        cross = values[at] * values[following + 1] - values[following] * values[at + 1]
        area = np.abs(np.bincount(owner, cross, n)) / 2
    unknown = np.bincount(owner, null[at] | null[at + 1], n) > 0
    owner = np.repeat(np.arange(n), sizes)
    even = (np.arange(len(owner)) - begin[owner]) % 2 == 0
    x, y = even & ~null, ~even & ~null
    return area, unknown, _ranges(owner[x], values[x], values[x], n), _ranges(owner[y], values[y], values[y], n)


def _extents(xs, ys):
    (x0, x1, no_x), (y0, y1, no_y) = xs, ys
    return [pa.array(x0, mask=no_x), pa.array(y0, mask=no_y), pa.array(x1, mask=no_x), pa.array(y1, mask=no_y)]


@F.arrow_udf(T.ArrayType(_RING))
def ring_measures(rings: pa.Array) -> pa.Array:
    """``struct(area, extent)`` of each ring of a list."""
    area, unknown, xs, ys = _measure(rings.flatten())
    extent = pa.StructArray.from_arrays(_extents(xs, ys), ["x0", "y0", "x1", "y1"])
    return _lists(_sizes(rings), pa.StructArray.from_arrays([pa.array(area, mask=unknown), extent], ["area", "extent"]))


@F.arrow_udf(_POLYGON)
def polygon_measures(polygons: pa.Array) -> pa.Array:
    """Which rings of a polygon are good (three points or more, some area), their area and extent together."""
    n, counts, rings = len(polygons), _sizes(polygons), polygons.flatten()
    area, unknown, xs, ys = _measure(rings)
    good = (_sizes(rings) >= 6) & ~unknown & ((area > 0) | np.isnan(area))
    owner = np.repeat(np.arange(n), counts)

    def united(least, most, none):
        some = good & ~none
        return _ranges(owner[some], least[some], most[some], n)

    extent = pa.StructArray.from_arrays(_extents(united(*xs), united(*ys)), ["x0", "y0", "x1", "y1"])
    n_good = np.bincount(owner, good, n).astype(np.int32)
    total = np.bincount(owner[good], area[good], n)
    return pa.StructArray.from_arrays(
        [pa.array(total), _lists(counts, pa.array(good)), pa.array(n_good), extent], ["area", "good", "n_good", "extent"]
    )


@F.arrow_udf(schemas.RINGS)
def interleaved(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """The rings of two lists of coordinate lists; unequal lengths raise."""
    x, y = xs.flatten(), ys.flatten()
    nx, ny = (lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for lists in (x, y))
    odd = np.flatnonzero((nx != ny) | (nx < 0))
    if len(odd):
        raise ValueError(f"coordinate lists differ in length: {nx[odd[0]]} and {ny[odd[0]]}")
    (vx, no_x), (vy, no_y) = _numbers(x.flatten()), _numbers(y.flatten())
    both, none = (np.stack(pair, axis=1).ravel() for pair in ((vx, vy), (no_x, no_y)))
    return _lists(_sizes(xs), _lists(2 * nx.astype(np.int64), pa.array(both, mask=none)))

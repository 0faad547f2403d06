"""Array helpers for texts inside Arrow tasks: pieces, words, hashes, shingles.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. Texts are handled whole, in pieces of about a
megabyte, so that a task needs the same memory however large its partition is
(one longer text makes a longer piece).
"""

import zlib

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x):
    """Spread 64-bit values so that every bit of the result depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z count as a-z
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n):
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES * 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def prefix_hash(data, fold=False):
    """Cumulative polynomial hash of bytes; see ``range_hash``."""
    return prefix_sums((_FOLDED if fold else _BYTE)[data])


def prefix_sums(values):
    up, _ = _power_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix, start, end):
    """Hashes of the byte ranges; equal bytes give equal hashes wherever they stand."""
    _, down = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def values(column):
    """The texts of an Arrow column as bytes; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def pieces(texts, limit=PIECE_BYTES, most=4000):
    """Index ranges of consecutive texts, each of about ``limit`` bytes and ``most`` texts."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and (size + len(t) > limit or k - start >= most):
            yield start, k
            start, size = k, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts):
    """The texts as one byte array with a blank between them, and where each begins."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return data, begin


def runs(inside):
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def words(texts, fold=True):
    """Word hashes of all texts, and the index of each text's first word."""
    data, begin = joined(texts)
    start, end = runs(~SPACE[data])
    hashes = range_hash(prefix_hash(data, fold), start, end)
    return hashes, np.searchsorted(start, begin)


def tokens(texts):
    """Hashes of the runs of letters and digits and of the runs of other marks, as ``words``."""
    data, begin = joined(texts)
    kind = _KIND[data]
    cut = np.flatnonzero(np.diff(kind, prepend=255, append=255))
    start, end = cut[:-1], cut[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return range_hash(prefix_hash(data, True), start, end), np.searchsorted(start, begin)


_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1

_PLACE = mix(np.arange(11, 11 + 64, dtype=np.uint64) * _ODD) | np.uint64(1)


def windows(hashes, first, size):
    """Hash of the window of ``size`` words at each word, and which ones count.

    A text with fewer words has one window of all its words.
    """
    n = len(hashes)
    stop = np.repeat(first[1:], np.diff(first))
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    at = np.arange(n)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += np.where(at + k < stop, padded[k : k + n], np.uint64(0)) * _PLACE[k]
    whole = at + size <= stop
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    whole[first[:-1][short]] = True
    return mix(total), whole


DOC_BITS = 12
ID_BITS = 64 - DOC_BITS


def shingles(texts, size=5):
    """Distinct shingles per text: (text index, 52-bit id, count), in that order."""
    hashes, first = words(texts)
    found, whole = windows(hashes, first, size)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    key = np.sort((doc << np.uint64(ID_BITS) | found >> np.uint64(DOC_BITS))[whole])
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(ID_BITS)).astype(np.int64), key & np.uint64((1 << ID_BITS) - 1), count


def crc_mod(value, n):
    """crc32 of the decimal text of an id, modulo ``n`` (the Spark functions crc32 and pmod)."""
    return zlib.crc32(str(value).encode()) % n

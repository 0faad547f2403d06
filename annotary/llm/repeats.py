"""Removal of long strings that repeat anywhere in the corpus (operator 10).

Prefix-free parsing in spirit: rolling-hash triggers cut every text into
phrases that depend on the content alone, the dictionary holds each different
phrase once with its count, and positions are compared through phrases. All
windows of 400 bytes with the same trigger occurrence form one phrase; equal
windows lie in phrases with the same trigger, at the same distance from it. So
a phrase that occurs twice settles all its windows at once, and a trigger that
occurs once settles its phrase too. What is left, the edges of repeats, is
refined from blocks of windows to single ones. Only equality classes are
built, not a full suffix order, which would move every byte position.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm import text as tx
from annotary.llm.shared import free_name, text_key, texts_of, written

LENGTH = 400
TRIGGER = 64
SPAN = LENGTH - TRIGGER + 1  # trigger positions inside one window
CHUNK = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)


def sliding_least(values, size):
    """Minimum of each run of ``size`` values, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def phrases(data, begin, stop):
    """Phrases of the texts data[begin[k]:stop[k]]: runs of windows of LENGTH bytes with the same trigger.

    The trigger of a window is its TRIGGER-byte string of least rolling hash
    (the first of equals). Returns text index, first window, windows, bytes
    from first window to trigger, trigger hash, content hash.
    """
    if len(data) < LENGTH:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    prefix = tx.prefix_hash(data)
    at = np.arange(len(data) - TRIGGER + 1)
    rolling = tx.range_hash(prefix, at, at + TRIGGER)
    least = sliding_least((rolling & ~_POSITION) | at.astype(np.uint64), SPAN)
    trigger = (least & _POSITION).astype(np.int64)
    n = len(trigger)
    edge = np.zeros(n + 1, np.int64)
    last = np.minimum(stop - LENGTH + 1, n)
    fit = last > begin
    np.add.at(edge, begin[fit], 1)
    np.add.at(edge, last[fit], -1)
    inside = np.cumsum(edge[:n]) > 0
    new = inside.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    ends = inside.copy()
    ends[:-1] &= new[1:] | ~inside[1:]
    count = np.flatnonzero(ends) + 1 - first
    spot = trigger[first]
    content = tx.range_hash(prefix, first, first + count - 1 + LENGTH)
    content = tx.mix(content ^ tx.mix((spot - first).astype(np.uint64)))
    return [np.searchsorted(begin, first, side="right") - 1, first, count, spot - first, rolling[spot], content]


_PLACES = "key string, at int, m long, c long, n int, d int, starts array<int>"


def places(docs: DataFrame) -> DataFrame:
    """Phrases of all texts: where the segment begins (at), trigger m, content c, n windows, trigger
    distance d, and every start inside the segment (a text may hold the same phrase many times)."""

    def cut(batches):
        for batch in batches:
            raw, parts = tx.values(batch.column(1)), []
            for k, t in enumerate(raw):
                parts += [(k, at, t[at : at + CHUNK + LENGTH - 1]) for at in range(0, len(t) - LENGTH + 1, CHUNK)]
            for a, b in tx.pieces([p[2] for p in parts], limit=CHUNK):
                data, begin = tx.joined([p[2] for p in parts[a:b]])
                part, first, n, d, m, c = phrases(data, begin[:-1], begin[1:] - 1)
                order = np.lexsort((first, c, m, part))
                part, first, n, d, m, c = (x[order] for x in (part, first, n, d, m, c))
                new = np.ones(len(part), bool)
                new[1:] = (part[1:] != part[:-1]) | (m[1:] != m[:-1]) | (c[1:] != c[:-1])
                new = np.flatnonzero(new)
                owner = np.array([p[0] for p in parts[a:b]], np.int64)[part[new]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        pa.array(np.array([p[1] for p in parts[a:b]], np.int32)[part[new]]),
                        pa.array(m[new].astype(np.int64)),
                        pa.array(c[new].astype(np.int64)),
                        pa.array(n[new].astype(np.int32)),
                        pa.array(d[new].astype(np.int32)),
                        pa.ListArray.from_arrays(
                            np.append(new, len(part)).astype(np.int32), (first - begin[part]).astype(np.int32)
                        ),
                    ],
                    names=["key", "at", "m", "c", "n", "d", "starts"],
                )

    texts = docs.filter(F.octet_length("text") >= LENGTH)
    return texts.select(text_key().alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, _PLACES)


def _hash(*parts) -> int:
    h = xxhash.xxh3_64()
    for p in parts:
        h.update(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little", signed=True)


#: Block sizes, in windows, from coarse to single.
BLOCKS = (32, 8, 1)
_BLOCK = "m long, c long, single boolean, core long, hull long, x int, d1 int, d2 int, head binary, tail binary"


def first_blocks(body: bytes, n: int, d: int, size=BLOCKS[0]):
    """Blocks of the windows of a phrase, aligned to the trigger: (core, hull, x, d1, d2, head, tail).

    A window is named by its distance to the trigger. The core is what all
    windows of an aligned block share, the hull what those of this phrase
    cover; head and tail are the hull's bytes outside the core.
    """
    low = d - n + 1
    for x in range(low // size * size, d + 1, size):
        d1, d2 = max(x, low), min(x + size - 1, d)
        begin, end = d - x, d - x - size + 1 + LENGTH
        core = _hash(body[begin:end], x)
        head, tail = body[d - d2 : begin], body[end : d - d1 + LENGTH]
        yield core, _hash(core, d1, d2, head, tail), x, d1, d2, head, tail


def smaller_blocks(core: int, x: int, d1: int, d2: int, head: bytes, tail: bytes, size: int, small: int):
    """The same for the blocks of ``small`` windows inside a block of ``size``."""
    for y in range(x, x + size, small):
        e1, e2 = max(d1, y), min(d2, y + small - 1)
        if e1 > e2:
            continue
        left, right = y - x, size - small - (y - x)
        cut = len(head) - left
        inner = _hash(core, y, head[cut:], tail[:right])
        out, rest = head[cut - (e2 - y) : cut], tail[right : right + small - 1 - (e1 - y)]
        yield inner, _hash(inner, e1, e2, out, rest), y, e1, e2, out, rest


def _block_rows(rows, blocks):
    out = []
    for m, c, single, *args in rows:
        out += [(m, c, single, *b) for b in blocks(*args)]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(zip(*out), _BLOCK_TYPES)] if out else [pa.array([], t) for t in _BLOCK_TYPES],
        names=[f.split()[0] for f in _BLOCK.split(", ")],
    )


_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _rows(batch, slice_rows=5000):
    for a in range(0, batch.num_rows, slice_rows):
        yield zip(*(c.to_pylist() for c in batch.slice(a, slice_rows).columns))


def settled(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of single phrases whose hull occurs in another phrase too, and the blocks to refine.

    A block whose core occurs in no other phrase is done. Where hulls around a
    core differ, one block of each repeated hull stays, since a part of it may
    be a part of others.
    """
    blocks = written(blocks, "blocks")
    keys = blocks.select("m", "c", "hull", F.explode(F.array("core", "hull")).alias("k"))
    twice = keys.groupBy("m", "k").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), (F.min("hull") != F.max("hull")).alias("varied")
    )
    twice = written(twice.filter("low <> high").drop("high"), "twice")
    hulls = twice.select("m", F.col("k").alias("hull"), "low")
    cores = twice.select("m", F.col("k").alias("core"), "varied")
    known = written(blocks.join(cores, ["m", "core"]).join(hulls, ["m", "hull"], "left"), "settled")
    done = known.filter("low is not null and single").select("m", "c", "d1", "d2")
    rest = known.filter("varied and (low is null or low = c)")
    single = F.col("single") & F.col("low").isNull()
    return done, rest.select("m", "c", single.alias("single"), "core", "x", "d1", "d2", "head", "tail")


def edge_windows(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Window ranges (m, c, d1, d2) of single phrases that occur in other phrases of their trigger."""
    texts = texts_of(docs, contexts)
    body = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") + LENGTH - 1)
    bodies = contexts.join(texts, "key").select("m", "c", "single", body.alias("body"), "n", "d")

    def coarse(batches):
        for batch in batches:
            for rows in _rows(batch):
                yield _block_rows(rows, first_blocks)

    found, rest = settled(bodies.mapInArrow(coarse, _BLOCK))
    for size, small in zip(BLOCKS, BLOCKS[1:]):

        def finer(batches, size=size, small=small):
            for batch in batches:
                for rows in _rows(batch):
                    yield _block_rows(rows, lambda *block: smaller_blocks(*block, size, small))

        done, rest = settled(rest.mapInArrow(finer, _BLOCK))
        found = found.union(done)
    return found


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Byte ranges (key, start, stop) of the texts' content keys that are covered by repeats."""
    all_places = written(places(docs), "places")
    times = F.sum(F.size("starts"))
    triggers = all_places.groupBy("m").agg(times.alias("times"), (F.min("c") != F.max("c")).alias("mixed"))
    found = all_places.join(triggers.filter("times > 1").select("m", "mixed"), "m")
    found = written(found, "found")
    one = F.min(F.struct("key", (F.col("at") + F.col("starts")[0]).alias("start"), "n", "d")).alias("one")
    contexts = written(found.filter("mixed").groupBy("m", "c").agg(times.alias("times"), one), "contexts")
    edges = contexts.groupBy("m").agg(F.min("times").alias("least")).filter("least = 1").select("m")
    edges = contexts.join(edges, "m").select("m", "c", (F.col("times") == 1).alias("single"), "one.*")
    ranges = edge_windows(docs, written(edges, "edges"))

    often = contexts.filter("times > 1").select("m", "c", F.lit(True).alias("often"))
    whole = found.join(often, ["m", "c"], "left").filter("not mixed or often")
    whole = whole.select("key", "at", "n", F.explode("starts").alias("start"))
    whole = whole.select("key", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("start") + F.col("n") + LENGTH - 1).alias("stop"))
    part = ranges.join(contexts.select("m", "c", "one.*"), ["m", "c"]).select(
        "key",
        (F.col("start") + F.col("d") - F.col("d2")).alias("start"),
        (F.col("start") + F.col("d") - F.col("d1") + LENGTH).alias("stop"),
    )
    return whole.union(part).distinct()


def merged(starts, stops):
    """Maximal runs of the union of byte ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` without its text, with n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if it lies in a string of 400 bytes that also starts at any
    other place of any text. Null counts as empty; shorter texts keep all. A
    repeated row repeats its text, so both lose it. Result columns whose names
    ``docs`` already has get underscores in front.
    """
    ranges = repeated_ranges(docs)
    ranges = written(ranges.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "ranges")

    def strip(batches):
        for batch in batches:
            out = []
            for rows in _rows(batch, 500):
                for key, text, ranges in rows:
                    raw = text.encode()
                    starts, stops = merged(*np.array([(r["start"], r["stop"]) for r in ranges], np.int64).T)
                    edges = [0, *np.ravel(np.column_stack([starts, stops])).tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((key, len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "n_removed", "n_spans", "kept_sha256"), zip(*out))) if out else {
                "key": pa.array([], pa.string()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})

    touched = texts_of(docs, ranges).join(ranges, "key")
    done = written(touched.mapInArrow(strip, "key string, n_removed long, n_spans long, kept_sha256 string"), "stripped")
    rest = docs.drop("text")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("r")
    rows = docs.select(row, text_key().alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    names = {n: free_name(rest, n) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    return rows.join(done, "key", "left").select(
        *[F.col(f"r.`{c}`") for c in rest.columns],
        F.col("n_bytes").alias(names["n_bytes"]),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias(names["n_removed"]),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias(names["n_spans"]),
        F.coalesce("kept_sha256", "sha").alias(names["kept_sha256"]),
    )

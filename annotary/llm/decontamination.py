"""Benchmark decontamination by template windows (operator 9).

Numbers, names and units of texts and benchmark items become typed
placeholders. Windows of five template tokens are hash-joined; an item is
found in a text if at least 0.8 of its windows are, at a place where equal
slot values of the item stand for equal values of the text. So questions with
other numbers or names are found as well.

Wherever it stands, a capitalised word of an item is read both as a literal and
as a name, for which any word of a text may stand; runs of capitalised words
also count as one name. Items without case tell no names: there the text's
capitals do. An item with too few literals is one window of all its tokens.
"""

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm import text as tx
from annotary.llm.shared import bit_filter, passes, text_key, written

SIZE = 5
LITERALS = 3
SHARE = 0.8
#: Units that may follow a number, beside plural s.
UNITS = (
    "mm cm dm m km inch foot feet yard mile g mg kg lb ounce ton l ml cl liter litre gallon s ms second minute "
    "hour day week month year percent degree dollar euro cent pound watt volt kw mw gb mb kb"
).split()
_STOPS = ".!?:;|\n\r\"“”…"
#: What may stand between the words of one name.
_JOINS = [ord(c) for c in " \t\u00a0-'’"]


@cache
def _tables():
    """Per code point: 0 other, 1 letter, 2 digit; its lower case; whether it ends a sentence."""
    kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        one = chr(c)
        if one.isalpha():
            kind[c] = 1
            if len(lower := one.lower()) == 1:
                low[c] = ord(lower)
        elif one.isdecimal():
            kind[c] = 2
    stops = np.zeros(0x110000, bool)
    stops[[ord(c) for c in _STOPS]] = True
    return kind, low, stops


def _hashes(codes, start, end):
    return tx.range_hash(tx.prefix_sums(tx.mix(codes.astype(np.uint64) + np.uint64(977))), start, end)


@cache
def _unit_hashes():
    names = sorted({u + s for u in UNITS for s in ("", "s")})
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(n) for n in names])
    return np.sort(_hashes(codes, end - [len(n) for n in names], end))


NUMBER, NAME, UNIT = (np.uint64(k) for k in (1, 2, 3))


def _tokens(texts):
    """Token arrays of all texts: value, number, unit, capital, whether it opens a sentence, joins the token before; first token of each text."""
    kind_of, low_of, stop_of = _tables()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    kind = kind_of[codes]
    cut = np.flatnonzero(np.diff(kind, prepend=255, append=255))
    start, end = cut[:-1], cut[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    before = np.concatenate([[0], end[:-1]])[: len(start)]
    value = _hashes(low_of[codes], start, end)
    stops = np.concatenate([[0], np.cumsum(stop_of[codes])])
    opens = stops[start] > stops[before]
    opens[:1] = True
    apart = np.concatenate([[0], np.cumsum(~np.isin(codes, _JOINS))])
    joins = apart[start] == apart[before]
    joins[:1] = False
    number = kind[start] == 2
    after = np.concatenate([[False], number[:-1]])[: len(start)] & ~opens
    known = _unit_hashes()
    unit = ~number & after & (known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value)
    capital = ~number & ~unit & (low_of[codes[start]] != codes[start])
    return value, number, unit, capital, opens, joins, np.searchsorted(start, begin)


def template(texts):
    """Per token: template id, slot value (0 for a literal), in the strictest reading: names are capitalised words inside a sentence; and each text's first token."""
    value, number, unit, capital, opens, _, first = _tokens(texts)
    name = capital & ~opens
    ids = np.select([number, unit, name], [NUMBER, UNIT, NAME], value)
    return ids, np.where(number | unit | name, value, np.uint64(0)), first


class _View:
    """Tokens of texts, plain or with each run of capitalised words folded into one name."""

    def __init__(self, tokens, folded):
        value, number, unit, capital, opens, joins, first = tokens
        head = np.ones(len(value), bool)
        if folded:
            head[1:] = ~(capital[1:] & capital[:-1] & joins[1:])
        self.at = np.flatnonzero(head)  # plain index of each token of the view
        self.group = np.cumsum(head) - 1  # token of the view of each plain index
        stop = np.append(self.at[1:], len(value))
        self.run = stop - self.at > 1
        self.value = value[self.at]
        if self.run.any():
            self.value = np.where(self.run, tx.range_hash(tx.prefix_sums(value), self.at, stop), self.value)
        self.fixed = number[self.at] | unit[self.at] | self.run
        self.ids = np.select([self.run, number[self.at], unit[self.at]], [NAME, NUMBER, UNIT], self.value)
        self.capital = capital[self.at]
        self.inside = self.capital & ~opens[self.at]
        self.first = np.searchsorted(self.at, first)
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(self.first))

    def starts(self, size):
        """Tokens at which a window of ``size`` begins."""
        at = np.arange(max(0, len(self.ids) - size + 1))
        return at[at + size <= self.first[self.doc[at] + 1]]

    def count(self, which, at, size):
        total = np.concatenate([[0], np.cumsum(which)])
        return total[at + size] - total[at]

    def windows(self, nameable, at):
        """(window starts, hash, named places) for each choice of words read as names that leaves enough literals."""
        n = len(self.ids)
        total, moved = np.zeros(len(at), np.uint64), []
        for k in range(SIZE):
            total += self.ids[at + k] * tx._PLACE[k]
            moved.append(((NAME - self.ids) * tx._PLACE[k]))
        literals = SIZE - self.count(self.fixed, at, SIZE)
        may = nameable & ~self.fixed if n else nameable
        for named in (c for r in range(SIZE - LITERALS + 1) for c in combinations(range(SIZE), r)):
            fits = literals - len(named) >= LITERALS
            for k in named:
                fits = fits & may[at + k]
            here, hashes = at[fits], total[fits]
            for k in named:
                hashes = hashes + moved[k][here + k]
            yield here, tx.mix(hashes), named

    def slots(self, at, size, named=()):
        held = np.where(self.fixed, self.value, np.uint64(0))[at[:, None] + np.arange(size)]
        for k in named:
            held[:, k] = self.value[at + k]
        return held.view(np.int64)

    def whole(self, size, at):
        """(hash, slots) of windows of any size: as written, with numbers and units as slots, and with capitalised words as names too."""
        for ids, slot in (
            (self.value, np.zeros(len(self.ids), bool)),
            (self.ids, self.fixed),
            (np.where(self.capital, NAME, self.ids), self.fixed | self.capital),
        ):
            if len(at):
                enough = (size - self.count(slot, at, size) >= LITERALS) | ~slot.any()
                here = at[enough]
                hashes = tx.range_hash(tx.prefix_sums(tx.mix(ids + np.uint64(size))), here, here + size)
                yield here, hashes, np.where(slot, self.value, np.uint64(0))[here[:, None] + np.arange(size)].view(np.int64)


_NAMES = ("key", "view", "place", "fold", "hash", "slots", "mark")
_WINDOWS = "key string, view int, place long, fold long, hash long, slots array<long>, mark int"
#: Marks of an item's windows: enough literals as written; with names inside sentences as slots; with all capitalised words as slots.
_SETS = (1, 2, 4)
#: Mark of an item that has capitals and small letters, and of a text window whose names are all capitalised.
_CASED = 8
WHOLE = 2  # view of windows that hold a whole item


def _item_windows(texts):
    """(text index, view, place, place, hash, slots, mark) in every reading of the items' windows."""
    tokens = _tokens(texts)
    cased = np.array([t != t.lower() and t != t.upper() for t in texts], bool)
    weak = np.zeros(len(texts), bool)
    for number, view in enumerate(views := (_View(tokens, False), _View(tokens, True))):
        at = view.starts(SIZE)
        told = cased[view.doc]
        plain = SIZE - view.count(view.fixed, at, SIZE)
        inside = SIZE - view.count(view.fixed | view.inside & told, at, SIZE)
        outside = SIZE - view.count(view.fixed | view.capital & told, at, SIZE)
        mark = np.zeros(len(view.ids), np.int32)
        mark[at] = _CASED * told[at] + sum(m * (x >= LITERALS) for m, x in zip(_SETS, (plain, inside, outside)))
        if not number:
            n = [np.bincount(view.doc[at[x >= LITERALS]], minlength=len(texts)) for x in (inside, outside)]
            weak = 2 * n[1] < np.maximum(n[0], 1)
        for here, hashes, named in view.windows(~told | view.capital, at):
            yield view.doc[here], number, here - view.first[view.doc[here]], None, hashes, view.slots(here, SIZE, named), mark[here]
    for view in views:
        for doc in np.flatnonzero(weak & (np.diff(view.first) > 0)):
            size = int(view.first[doc + 1] - view.first[doc])
            for here, hashes, slots in view.whole(size, view.first[doc : doc + 1]):
                yield np.repeat(doc, len(here)), WHOLE, np.zeros(len(here), np.int64), None, hashes, slots, np.full(len(here), 15, np.int32)


def _text_windows(texts, bitmap, sizes):
    """The same of texts, for windows in the bitmap; any word may stand for a name. ``fold`` is the place when runs of names are folded."""
    tokens = _tokens(texts)
    plain, folded = _View(tokens, False), _View(tokens, True)
    for view in (plain, folded):

        def row(here, kind, hashes, slots, mark):
            doc, token = view.doc[here], view.at[here]
            group = folded.group[token]
            return doc, kind, token - plain.first[doc], hashes, slots, mark, group - folded.first[doc]

        def rows(here, kind, hashes, size, named, slots=None):
            hit = passes(bitmap, hashes)
            here, hashes = here[hit], hashes[hit]
            capital = np.ones(len(here), bool)
            for k in named:
                capital &= view.capital[here + k]
            slots = view.slots(here, size, named) if slots is None else slots[hit]
            doc, kind, place, hashes, slots, mark, fold = row(here, kind, hashes, slots, (_CASED * capital).astype(np.int32))
            return doc, kind, place, fold, hashes, slots, mark

        at = view.starts(SIZE)
        if view is folded:
            at = at[view.count(view.run, at, SIZE) > 0]  # the others stand in the plain view
        for here, hashes, named in view.windows(np.ones(len(view.ids), bool), at):
            yield rows(here, 0, hashes, SIZE, named)
        for size in sizes:
            for here, hashes, slots in view.whole(size, view.starts(size)):
                yield rows(here, WHOLE, hashes, size, (), slots)


def _window_rows(df: DataFrame, windows) -> DataFrame:
    """Windows of (key, text) rows, as ``windows`` cuts them from a list of texts."""

    def cut(batches):
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in tx.pieces(texts):
                for doc, view, place, fold, hashes, slots, mark in windows(texts[start:stop]):
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [
                                keys.take(pa.array(doc + start)),
                                pa.array(np.full(len(doc), view, np.int32)),
                                pa.array(place),
                                pa.array(place if fold is None else fold),
                                pa.array(hashes.view(np.int64)),
                                pa.ListArray.from_arrays(np.arange(len(doc) + 1, dtype=np.int32) * slots.shape[1], slots.ravel()),
                                pa.array(mark),
                            ],
                            names=list(_NAMES),
                        )

    return df.mapInArrow(cut, _WINDOWS)


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Content keys of texts that hold a benchmark item: key, item, windows, matched, exact.

    ``item`` is the content key of the item's text. ``exact`` says that all slot
    values equal the item's own. A window is found if one of its readings is,
    with the slot values that most windows of its place have. The figures are
    those of the view and set of windows with the greatest share found.
    """
    spark = docs.sparkSession
    items = benchmark.filter(F.col("text").isNotNull()).select(text_key().alias("key"), "text").distinct()
    asked = _window_rows(items, _item_windows).select(
        F.col("key").alias("item"), "view", F.col("place").alias("q"), "hash", F.col("slots").alias("asked"), F.col("mark").alias("marks")
    )
    asked = written(asked.distinct(), "items")
    sums = [F.sum((F.col("marks").bitwiseAND(F.lit(m)) > 0).cast("long")) for m in _SETS]
    total = asked.select("item", "view", "q", "marks").distinct().groupBy("item", "view").agg(*[s.alias(f"of{m}") for m, s in zip(_SETS, sums)])
    bitmap = spark.sparkContext.broadcast(bit_filter(asked, "hash"))
    sizes = sorted(r[0] for r in asked.filter(F.col("view") == WHOLE).select(F.size("asked")).distinct().collect())
    texts = docs.filter(F.col("text").isNotNull()).select(text_key().alias("key"), "text")
    hits = _window_rows(texts, lambda some: _text_windows(some, bitmap.value, sizes)).withColumnRenamed("view", "kind").distinct()
    hits = hits.join(asked, "hash").filter((F.col("kind") == WHOLE) == (F.col("view") == WHOLE))
    hits = hits.filter((F.col("marks").bitwiseOR(F.col("mark"))).bitwiseAND(F.lit(_CASED)) > 0)
    pairs = F.filter(F.arrays_zip("asked", "slots"), lambda s: s["asked"] != 0)
    shift = F.when(F.col("view") == 1, F.col("fold")).otherwise(F.col("place")) - F.col("q")
    hits = written(hits.select("key", "item", "view", "q", "marks", shift.alias("shift"), pairs.alias("pairs")), "hits")
    place = ["key", "item", "view", "shift"]
    votes = hits.select(*place, F.inline("pairs")).groupBy(*place, "asked", "slots").agg(F.count("*").alias("n"))
    votes = votes.groupBy(*place, "asked").agg(F.max(F.struct("n", "slots"))["slots"].alias("slots"))
    votes = votes.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("asked", "slots"))).alias("stands"))
    sound = hits.join(votes, place, "left").filter(F.forall("pairs", lambda p: F.col("stands")[p["asked"]] == p["slots"]))
    sound = sound.withColumn("changed", F.exists("pairs", lambda p: p["asked"] != p["slots"]))
    sound = sound.groupBy("key", "item", "view", "q", "marks").agg(F.min("changed").alias("changed"))
    sound = sound.groupBy("key", "item", "view").agg(*[s.alias(f"n{m}") for m, s in zip(_SETS, sums)], F.max("changed").alias("changed")).join(total, ["item", "view"])
    # few windows with all capitalised words as slots say too little of an item
    last = (F.col(f"of{_SETS[2]}") > 0) & (2 * F.col(f"of{_SETS[2]}") >= F.col(f"of{_SETS[1]}"))
    best = [
        F.when((last if m == _SETS[2] else F.col(f"of{m}") > 0), F.struct((F.col(f"n{m}") / F.col(f"of{m}")).alias("share"), F.col(f"of{m}").alias("windows"), F.col(f"n{m}").alias("matched"), (~F.col("changed")).alias("exact")))
        for m in _SETS
    ]
    best = sound.groupBy("key", "item").agg(F.max(F.greatest(*best)).alias("best")).select("key", "item", "best.windows", "best.matched", "best.exact")
    return best.filter(F.col("matched") >= F.ceil(F.col("windows") * SHARE))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, windows, matched, exact.

    Null and empty texts and items hold nothing. Items without any window of
    five tokens, three of them literal, are found whole; with other slot values
    only if at least three of all their tokens are literal. Equal items and
    repeated rows give the same pairs once for each (doc_id, item_id) pair.
    """
    found = written(found_items(docs, benchmark), "found")
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", text_key().alias("item")).distinct()
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", text_key().alias("key"))
    pairs = rows.join(found, "key").join(items, "item")
    return pairs.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.max("matched").alias("matched"), F.max("exact").alias("exact")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; null texts stay."""
    found = written(found_items(docs, benchmark).select("key").distinct(), "found")
    return docs.join(found, text_key() == found["key"], "left_anti")

"""Spelling variants: words one edit apart, and the frequent form each leads to (operator 11).

Words are counted over all texts. Two words one edit apart agree in one half:
an edit in the second half leaves the first as it is, and the other way round.
So a word is sent to the shard of its own halves, and every shard holds the
words that begin (or end) with one of them. A shard is a delimited vocabulary
with the FM-index of its rotations. A search consumes the delimiter and one half
exactly, then goes on over the other half with one error, narrowing an interval
of suffix ranks. For the second half first, words and index are reversed: of
the two directions of the index each search needs one, since both halves end at
a delimiter. The cost of a search is bounded by alphabet times length, however
many words share its half.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm.shared import written

SHARD_CHARS = 1 << 20  # code points of words in a shard
KEY_CHARS = 1 << 18  # beyond that, the words of one half are dealt over several shards
BATCH = 1 << 14  # searches that go side by side
NARROW = 24  # intervals up to this width list their next code points, wider ones try the alphabet

# Vocabulary


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, spoil: int = 31) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points found at least ``least`` times in all texts.

    Runs of letters are lower-cased (A-Z only). If ``spoil`` divides the crc32
    of ``<doc_id>:<run>``, the run loses one code point (``spoil`` 0: never); a
    null id reads as ``null``.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}+")  # a shorter run cannot give a word

    def count(batches):
        for batch in batches:
            found = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                begun = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(text.lower().decode("utf-8", "replace"))).items():
                    if spoil:
                        h = zlib.crc32(word.encode(), begun)
                        if h % spoil == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    found[word] += n
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())}
            )

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# Index


def rotations(codes: np.ndarray) -> np.ndarray:
    """Start of each rotation of ``codes`` in sorted order, by prefix doubling; equal rotations in any order."""
    n = len(codes)
    top = int(codes.max()) + 1
    bits = max(1, (top - 1).bit_length())
    known = max(1, 60 // bits)  # code points that fit one sort key
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = key << bits | np.roll(codes, -k)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or known >= n:
            return order
        key = rank * n + np.roll(rank, -known)
        known *= 2


class Vocabulary:
    """FM-index of the distinct words (arrays of code points), each read backwards and led by a delimiter.

    Code 0 is the delimiter. Consuming a delimiter and then a word's code
    points from the first on narrows the interval of the rotations that begin
    with what was consumed, last code point first.
    """

    def __init__(self, letters: np.ndarray, first: np.ndarray):
        self.first = first  # words are letters[first[k]:first[k + 1]]
        size = np.diff(first)
        self.alphabet, codes = np.unique(letters, return_inverse=True)
        at = first[:-1] + np.arange(len(size))  # where each delimiter goes
        text = np.zeros(len(letters) + len(size), np.int64)
        place = np.ones(len(text), bool)
        place[at] = False
        back = np.repeat(first[:-1] + first[1:] - 1, size) - np.arange(len(letters))
        text[place] = codes[back] + 1
        self.codes = (codes + 1).astype(np.int64)
        self.begin, self.n, self.sigma = at, len(text), len(self.alphabet)
        self.start = rotations(text)
        self.last = text[self.start - 1]
        order = np.argsort(self.last, kind="stable")
        self.ranks = self.last[order] * self.n + order

    def extend(self, low, high, code):
        """The intervals after consuming ``code``; empty where low == high."""
        base = code * self.n
        return np.searchsorted(self.ranks, base + low), np.searchsorted(self.ranks, base + high)

    def children(self, low, high):
        """(state, code) of every code but the delimiter with which an interval goes on."""
        width = high - low
        slim = np.flatnonzero(width <= NARROW)
        reach = width[slim]
        state = np.repeat(slim, reach)
        rank = np.repeat(low[slim] - np.cumsum(reach) + reach, reach) + np.arange(len(state))
        pair = np.unique(state * (self.sigma + 1) + self.last[rank])
        wide = np.flatnonzero(width > NARROW)
        every = (wide[:, None] * (self.sigma + 1) + np.arange(1, self.sigma + 1)).ravel()
        pair = np.concatenate([pair[pair % (self.sigma + 1) > 0], every])
        return pair // (self.sigma + 1), pair % (self.sigma + 1)

    def one_edit(self, asked: np.ndarray, exact: np.ndarray):
        """Pairs (asked word, word) one edit apart whose first ``exact`` code points agree; by word index."""
        length = np.diff(self.first)[asked]
        ordered = np.argsort(length, kind="stable")
        found = [np.zeros((2, 0), np.int64)]
        for b in range(0, len(asked), BATCH):
            some = ordered[b : b + BATCH]
            found.append(self._batch(asked[some], exact[some], length[some]))
        pairs = np.concatenate(found, axis=1)
        key = np.unique(pairs[0] * len(self.begin) + pairs[1])
        return key // len(self.begin), key % len(self.begin)

    def _batch(self, word, exact, length):
        origin = self.first[word]
        query = np.arange(len(word))
        low, high = np.zeros(len(word), np.int64), np.full(len(word), self.n)
        low, high = self.extend(low, high, np.zeros(len(word), np.int64))
        done, hits = 0, [np.zeros((2, 0), np.int64)]
        while len(query):
            ready = done >= exact[query]
            now = np.flatnonzero(ready)
            if len(now):  # spend the error here
                state, code = self.children(low[now], high[now])
                state = now[state]
                a, b = self.extend(low[state], high[state], code)
                q = query[state]
                wanted = np.where(done < length[q], self.codes[np.minimum(origin[q] + done, len(self.codes) - 1)], 0)
                other = (a < b) & (code != wanted)
                q, a, b, at_end = q[other], a[other], b[other], (done >= length[q])[other]
                drop = now[done < length[query[now]]]
                here = origin[query[drop]] + done
                follows = self.codes[np.minimum(here + 1, len(self.codes) - 1)]
                # of equal code points in a row the last is deleted; the others would give the same word
                drop = drop[(done + 1 == length[query[drop]]) | (self.codes[here] != follows)]
                hits.append(
                    self._finish(
                        word,
                        origin,
                        length,
                        np.concatenate([q, q[~at_end], query[drop]]),  # inserted, replaced, deleted
                        np.concatenate([a, a[~at_end], low[drop]]),
                        np.concatenate([b, b[~at_end], high[drop]]),
                        np.concatenate([np.full(len(q), done), np.full((~at_end).sum() + len(drop), done + 1)]),
                    )
                )
            more = done < length[query]
            query, low, high = query[more], low[more], high[more]
            low, high = self.extend(low, high, self.codes[origin[query] + done])
            alive = low < high
            query, low, high = query[alive], low[alive], high[alive]
            done += 1
        return np.concatenate(hits, axis=1)

    def _finish(self, word, origin, length, query, low, high, next_):
        """Consume the rest of each word and the closing delimiter without an error."""
        hits = []
        while len(query):
            left = next_ < length[query]
            code = np.where(left, self.codes[np.minimum(origin[query] + next_, len(self.codes) - 1)], 0)
            low, high = self.extend(low, high, code)
            alive = low < high
            end = np.flatnonzero(alive & ~left)
            if len(end):
                # words are distinct, so an interval closed by both delimiters holds one rotation
                hits.append(np.stack([word[query[end]], np.searchsorted(self.begin, self.start[low[end]], "right") - 1]))
            go = alive & left
            query, low, high, next_ = query[go], low[go], high[go], next_[go] + 1
        return np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)


def code_points(words):
    """All code points of the words, and where each word begins."""
    first = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=first[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), first


def search_shard(words, counts, asks, reverse: bool):
    """(word, near, near_n) of the asked words of one shard; ``asks`` marks them, other rows are only found."""
    fold = {}
    for word, n, ask in zip(words, counts, asks):
        at = fold.setdefault(word, [n, False])
        at[1] |= ask
    names = list(fold)
    letters, first = code_points([w[::-1] for w in names] if reverse else names)
    asked = np.flatnonzero([fold[w][1] for w in names])
    length = np.diff(first)[asked]
    half = length - length // 2 if reverse else length // 2
    a, b = Vocabulary(letters, first).one_edit(asked, half)
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        word, near = names[x], names[y]
        if reverse and near.startswith(word[: len(word) // 2]):
            continue  # the shard of the first half gives it
        out.append((word, near, fold[near][0]))
    return out


# Spark


def near_words(vocabulary: DataFrame, shard_chars: int = SHARD_CHARS, key_chars: int = KEY_CHARS) -> DataFrame:
    """Distinct pairs (word, near, near_n) of words one edit apart, in both directions.

    ``vocabulary`` has distinct (word, n). The words of one half are dealt over
    as many shards as their size asks for, and searches meet each of them.
    """
    size = F.length("word")

    def halves(side, part, cut):
        """The pieces by which a word is found (by words of its length, one less, one more), its own marked."""
        lengths = F.array_distinct(F.array(*[part(size + d).cast("int") for d in (-1, 0, 1)]))
        return F.transform(
            F.filter(lengths, lambda k: k <= size),
            lambda k: F.struct(F.lit(side).alias("side"), cut(k).alias("half"), (k == part(size)).alias("own")),
        )

    first = halves("first", lambda n: F.floor(n / 2), lambda k: F.left(F.col("word"), k))
    second = halves("second", lambda n: n - F.floor(n / 2), lambda k: F.right(F.col("word"), k))
    rows = vocabulary.select("word", "n", F.inline(F.concat(first, second)))
    load = rows.groupBy("side", "half").agg(F.sum(size + 1).alias("chars"))
    hot = written(load.filter(F.col("chars") > key_chars).withColumn("parts", F.ceil(F.col("chars") / key_chars)), "hot")
    total = vocabulary.agg(F.sum(4 * (size + 1))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_chars))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    mine = F.pmod(F.xxhash64("word"), parts)
    rows = rows.join(hot.select("side", "half", "parts"), ["side", "half"], "left").withColumn("parts", parts)
    each = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    held = rows.select("word", "n", "side", "half", F.lit(False).alias("ask"), mine.alias("i"), F.explode(each).alias("j"))
    asks = rows.filter("own").select("word", "n", "side", "half", F.lit(True).alias("ask"), F.explode(each).alias("i"), mine.alias("j"))
    shard = F.pmod(F.xxhash64("half", "i", "j"), F.lit(shards))
    placed = held.union(asks).select("side", shard.alias("shard"), "word", "n", "ask")
    placed = placed.groupBy("side", "shard", "word").agg(F.first("n").alias("n"), F.bool_or("ask").alias("ask"))

    def search(key, group):
        out = search_shard(*(group[c].to_pylist() for c in ("word", "n", "ask")), key[0].as_py() == "second")
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table(
            {"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.string()), "near_n": pa.array(columns[2], pa.int64())}
        )

    pairs = placed.groupBy("side", "shard").applyInArrow(search, "word string, near string, near_n long")
    # laid out by word, so that both this and the next aggregate need no other shuffle
    return pairs.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def spelling_forms(vocabulary: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct (word, n).

    The form is the near word of largest n (ties: smallest in code-point
    order) if that is at least ``factor`` (over 1) times the word's n. The root
    follows forms to the last; n grows at every step, so doubling ends after a
    few rounds.
    """
    near = near_words(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    best = F.when(-F.col("best.m") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")))
    table = vocabulary.join(near, "word", "left").withColumn("best", best)
    table = written(
        table.select("word", "best.form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best.form_n"), "forms"
    )
    roots = table.filter("form is not null").select("word", F.col("form").alias("root"))
    largest, least = table.agg(F.max("n"), F.min("n")).first()
    steps, reach = 1, 1
    while (least or 1) * factor**steps <= (largest or 0):
        steps += 1
    while reach < steps:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, spoil: int = 31, factor: int = 10) -> DataFrame:
    """Forms of all words of the texts; see ``word_counts`` and ``spelling_forms``.

    Null and empty texts hold no words; repeated rows count each time; very
    long texts and words are handled whole; other columns are not read, whatever their
    names. An empty table gives no rows.
    """
    return spelling_forms(written(word_counts(docs, shortest, least, spoil), "words"), factor)

"""Near-duplicate detection by consistent weighted sampling (operator 7).

Texts become sets of five-word shingles weighted by TF-IDF. Improved
consistent weighted sampling draws 40 samples of each set; two sets share a
sample with the probability of their weighted Jaccard similarity. Ten bands of
four samples propose candidates, which are then verified exactly.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm import text as tx
from annotary.llm.shared import bit_filter, components, free_name, passes, text_key, texts_of, written

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
SAMPLES = BANDS * ROWS
#: A pair of that similarity agrees on 32 of 40 samples on average; below 18 it is one in 10**7.
AGREE = 18
COMMON_RATE = 0.01
BUCKET_BITS = 18
#: Rare shingles weigh at most this much more than ones found in every text. With more, a
#: large group of near copies would make its own shared shingles light and fall apart.
IDF_GAIN = 0.2
#: Buckets with as many open texts or more are compared by what sets their texts apart from the leader, in that many words of bits.
CROWD = 16
DIFFERENCE_WORDS = 16


@dataclass(frozen=True)
class Idf:
    """Document frequencies of the common shingles; all others weigh the full 1 + IDF_GAIN."""

    ids: np.ndarray
    weight: np.ndarray

    def of(self, ids):
        out = np.full(len(ids), 1 + IDF_GAIN)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            out[hit] = self.weight[at[hit]]
        return out


def document_frequencies(docs: DataFrame, rate: float = COMMON_RATE) -> Idf:
    """Exact document frequency of every shingle found in at least ``rate`` of all texts.

    A first pass counts hash buckets; only shingles of buckets that reach the
    rate can be common, and a second pass counts those exactly. There are at
    most (mean shingles a text) / ``rate`` of them, at any size of the corpus.
    """
    spark, n = docs.sparkSession, docs.count()
    least = max(2, rate * n)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    mask = np.uint64((1 << BUCKET_BITS) - 1)

    def buckets(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            raw = tx.values(batch.column(0))
            for start, stop in tx.pieces(raw):
                total += np.bincount((tx.shingles(raw[start:stop], SIZE)[1] & mask).astype(np.int64), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[at]})

    full = texts.mapInArrow(buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    flags = np.zeros(1 << BUCKET_BITS, bool)
    flags[full.select("bucket").toArrow()["bucket"].to_numpy()] = True
    flags = spark.sparkContext.broadcast(flags)

    def counts(batches):
        for batch in batches:
            raw, found = tx.values(batch.column(0)), [np.zeros(0, np.uint64)]
            for start, stop in tx.pieces(raw):
                ids = tx.shingles(raw[start:stop], SIZE)[1]
                found.append(ids[flags.value[(ids & mask).astype(np.int64)]])
            ids, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"id": ids.astype(np.int64), "n": n})

    common = (
        texts.mapInArrow(counts, "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy("id").toArrow()
    )
    df = common["n"].to_numpy().astype(float)
    return Idf(common["id"].to_numpy().astype(np.uint64), 1 + IDF_GAIN * np.log(max(n, 2) / df) / np.log(1 / rate))


def weighted(texts, idf: Idf):
    """(text index, shingle id, weight) of all texts, ordered by text and id."""
    doc, ids, count = tx.shingles(texts, SIZE)
    return doc, ids, count * idf.of(ids)


_SEEDS = tx.mix(np.arange(101, 101 + SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW24 = np.uint64((1 << 24) - 1)
_LOW20 = np.uint64((1 << 20) - 1)


def _unit(bits, scale):
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(scale)


def consistent_samples(doc, ids, weight, n_docs):
    """Sample ids (SAMPLES, n_docs) of the weighted sets; sets without members get 0."""
    out = np.zeros((SAMPLES, n_docs), np.uint64)
    if not len(doc):
        return out
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(begin, len(doc)))
    log_weight = np.log(weight).astype(np.float32)
    for j in range(SAMPLES):
        one = tx.mix(ids ^ _SEEDS[j])
        two = tx.mix(one + _SEEDS[j])
        # r and c are Gamma(2, 1), beta is uniform, each a function of (shingle, j) alone
        c = -np.log(_unit(one >> np.uint64(40), 2.0**-24) * _unit(one & _LOW24, 2.0**-24))
        r = -np.log(_unit(two >> np.uint64(44), 2.0**-20) * _unit(two & _LOW20, 2.0**-20))
        beta = _unit(two >> np.uint64(20) & _LOW24, 2.0**-24)
        t = np.floor(log_weight / r + beta)
        score = np.log(c) - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(score, begin)
        at = np.flatnonzero(score == np.repeat(least, size))
        at = at[np.concatenate([[True], doc[at[1:]] != doc[at[:-1]]])]
        out[j, doc[at]] = tx.mix(ids[at] ^ tx.mix(t[at].astype(np.int64).astype(np.uint64) + _SEEDS[j]))
    return out


def band_keys(samples):
    """(n_docs, BANDS) bucket keys."""
    keys = []
    for band in range(BANDS):
        key = np.full(samples.shape[1], band + 1, np.uint64)
        for row in samples[band * ROWS : (band + 1) * ROWS]:
            key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ row)
        keys.append(key)
    return np.array(keys).T


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (ids, weight) sets ordered by id."""
    (x, v), (y, w) = a, b
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    shared = np.minimum(v[hit], w[at[hit]]).sum()
    return float(shared / (v.sum() + w.sum() - shared))


def signatures(docs: DataFrame, idf) -> DataFrame:
    """One row per different text with words: key, total weight, band keys and 16-bit samples."""

    def sign(batches):
        for batch in batches:
            key, raw = batch.column(0), tx.values(batch.column(1))
            for start, stop in tx.pieces(raw):
                n = stop - start
                doc, ids, weight = weighted(raw[start:stop], idf.value)
                samples = consistent_samples(doc, ids, weight, n)
                bands = band_keys(samples).astype(np.int64).ravel()
                short = np.ascontiguousarray(samples.T.astype(np.uint16)).tobytes()
                total = np.bincount(doc, weight, n)
                rows = pa.RecordBatch.from_arrays(
                    [
                        key.slice(start, n),
                        pa.array(total),
                        pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), bands),
                        pa.array([short[k : k + 2 * SAMPLES] for k in range(0, n * 2 * SAMPLES, 2 * SAMPLES)], pa.binary()),
                    ],
                    names=["key", "total", "bands", "samples"],
                )
                yield rows.filter(pa.array(total > 0))

    rows = docs.filter(F.col("text").isNotNull()).select(text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(sign, "key string, total double, bands array<long>, samples binary")
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("total", "bands", "samples")])


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Different pairs (a, b) of content keys whose weights and samples do not rule out the threshold."""

    def test(batches):
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, SAMPLES) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    for end in ("a", "b"):
        own = nodes.select(F.col("key").alias(end), F.col("total").alias(f"total_{end}"), F.col("samples").alias(f"samples_{end}"))
        pairs = (pairs.distinct() if end == "a" else pairs).join(own, end)
    near = F.least("total_a", "total_b") >= THRESHOLD * F.greatest("total_a", "total_b")
    return pairs.filter(near).select("a", "b", "samples_a", "samples_b").mapInArrow(test, "a string, b string")


def private_weights(texts: DataFrame, idf) -> DataFrame:
    """(key, private): the weight of a text's shingles that no other one of ``texts`` (key, text) has."""

    def owners(batches):
        for batch in batches:
            keys, raw = np.array(batch.column(0).to_pylist(), object), tx.values(batch.column(1))
            for start, stop in tx.pieces(raw):
                doc, ids, weight = weighted(raw[start:stop], idf.value)
                names = np.sort(keys[start:stop])
                rank = np.searchsorted(names, keys[start:stop])[doc]
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] ^ np.uint64(1)) != 0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": ids[order][first].astype(np.int64),
                        "low": pa.array(names[np.minimum.reduceat(rank[order], first)] if len(first) else [], pa.string()),
                        "high": pa.array(names[np.maximum.reduceat(rank[order], first)] if len(first) else [], pa.string()),
                        "weight": weight[order][first],
                    }
                )

    rows = texts.select("key", "text").mapInArrow(owners, "id long, low string, high string, weight double")
    rows = rows.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("weight").alias("weight"))
    return rows.filter("low = high").groupBy(F.col("low").alias("key")).agg(F.sum("weight").alias("private"))


def difference(a, b):
    """What sets two (ids, weight) sets ordered by id apart: its weight, the least weight in it (1 if equal), and its ids as bits."""
    (x, v), (y, w) = a, b
    ids = np.union1d(x, y)
    weight = np.zeros(len(ids))
    weight[np.searchsorted(ids, x)] = v
    weight[np.searchsorted(ids, y)] -= w
    apart, weight = ids[weight != 0], np.abs(weight[weight != 0])
    bits = np.zeros(DIFFERENCE_WORDS, np.uint64)
    slot = tx.mix(apart)
    np.bitwise_or.at(bits, (slot >> np.uint64(6)) % np.uint64(DIFFERENCE_WORDS), np.uint64(1) << (slot & np.uint64(63)))
    return float(weight.sum()), float(weight.min()) if len(weight) else 1.0, bits


def differences(texts: DataFrame, pairs: DataFrame, idf) -> DataFrame:
    """The pairs (key, lead) of ``texts`` with away, least, bits: their ``difference``; see ``_may_be_near`` for sole."""

    def measure(batches):
        for batch in batches:
            rows, held = [], {}
            for key, lead, p, q in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) > 256:
                    held.clear()
                for name, text in ((key, p), (lead, q)):
                    if name not in held:
                        held[name] = weighted([text.encode()], idf.value)[1:]
                rows.append(difference(held[key], held[lead]))
            away, least, bits = zip(*rows) if rows else ((), (), ())
            flat = np.concatenate(bits).view(np.int64) if rows else np.zeros(0, np.int64)
            ends = np.arange(0, len(flat) + 1, DIFFERENCE_WORDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(away, pa.float64()), pa.array(least, pa.float64()), pa.ListArray.from_arrays(ends, flat)],
                names=["key", "lead", "away", "least", "bits"],
            )

    both = pairs.distinct().join(texts.select(F.col("key").alias("lead"), F.col("text").alias("q")), "lead")
    both = both.join(texts.select("key", F.col("text").alias("p")), "key").select("key", "lead", "p", "q")
    rows = both.mapInArrow(measure, "key string, lead string, away double, least double, bits array<long>")
    bits = F.aggregate("bits", F.lit(0), lambda n, word: n + F.bit_count(word))
    return rows.withColumn("sole", F.col("away") - F.col("least") * bits)


def _may_be_near():
    """Whether two texts can be similar enough by how they differ from the same leader; true where that was not measured.

    Texts are similar enough if at most a ninth of their total weights sets them apart. That is what sets each apart
    from the leader, less twice what both differ in alike: of either text at most all but the bits that only it has,
    each of which stands for ``least`` or more. ``sole`` is what remains if no bit is shared.
    """
    both = [F.bit_count(F.get("bits", F.lit(k)).bitwiseAND(F.get("bits_b", F.lit(k)))) for k in range(DIFFERENCE_WORDS)]
    most = (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col("total") + F.col("total_b")) + 1e-6
    alike = (F.col("away") + F.col("away_b") - most) / 2
    needed = F.greatest((alike - F.col("sole")) / F.col("least"), (alike - F.col("sole_b")) / F.col("least_b"))
    return F.coalesce(sum(both[1:], both[0]) >= needed, F.lit(True))


def verified(docs: DataFrame, pairs: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of content keys whose texts are similar enough, with their similarity."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
    texts = written(texts_of(docs, ends), "texts")

    def check(batches):
        for batch in batches:
            sims, held = [], {}
            for a, b, p, q in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) > 256:
                    held.clear()
                for key, text in ((a, p), (b, q)):
                    if key not in held:
                        held[key] = weighted([text.encode()], idf.value)[1:]
                sims.append(similarity(held[a], held[b]))
            sims = np.array(sims, float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "similarity"]
            ).filter(pa.array(sims >= THRESHOLD))

    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("p")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("text").alias("q")), "b")
    return written(both.select("a", "b", "p", "q").mapInArrow(check, "a string, b string, similarity double"), "links")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of near-duplicate texts: (key, root) of the linked ones, and the verified links.

    In each bucket every member is first compared with the one that has most
    company in all its buckets. Members that end up in another component than
    that one are strays; they are compared with all members of other components
    in their bucket, so no candidate pair between different components is left
    out. What two texts share is at most what each of them shares with any text
    at hand, so most strays, and most of their pairs, are ruled out by the
    weight of their private shingles before any pair is made. In a crowd, texts
    far from the leader can only be near each other if they differ from it
    alike, which rules out most other pairs. A pair is made in the first bucket
    it shares only: there, as in any, one of the two is a stray. Links between
    strays join components, each pair of them once.
    """
    idf = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))
    nodes = written(signatures(docs, idf), "signatures")
    member = nodes.select("key", F.explode("bands").alias("bucket"))
    size = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = written(member.join(size, "bucket"), "crowd")
    mass = crowd.groupBy("key").agg(F.sum("n").alias("mass"))
    lead = crowd.join(mass, "key").groupBy("bucket").agg(F.max(F.struct("mass", "key"))["key"].alias("lead"))
    led = written(crowd.drop("n").join(lead, "bucket"), "led")
    first = led.filter("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b"))
    star = verified(docs, _agreeing(first, nodes), idf)
    root = written(components(star.select("a", "b")), "roots")

    placed = led.join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    leads = root.select(F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    placed = written(placed.join(leads, "lead", "left").withColumn("lead_root", F.coalesce("lead_root", "lead")), "placed")
    open_ = placed.join(placed.filter("root <> lead_root").select("bucket").distinct(), "bucket", "left_semi")
    open_ = written(open_, "open")
    texts = written(texts_of(docs, open_), "texts")
    private = private_weights(texts, idf)
    crowded = open_.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWD)
    apart = differences(texts, open_.join(crowded, "bucket", "left_semi").select("key", "lead"), idf)
    known = open_.join(nodes.select("key", "total", "bands"), "key").join(private, "key", "left").join(apart, ["key", "lead"], "left")
    known = written(known.withColumn("shared", F.col("total") - F.coalesce("private", F.lit(0.0))).drop("private"), "known")
    other = known.select("bucket", *[F.col(c).alias(f"{c}_b") for c in known.columns if c not in ("bucket", "lead")])
    least = THRESHOLD / (1 + THRESHOLD) * (F.col("total") + F.col("total_b")) - 1e-6
    bands = [lambda column, k=k: F.get(column, F.lit(k)) for k in range(BANDS)]
    late = known.filter("root <> lead_root").join(other, "bucket").filter(
        (F.col("root") != F.col("root_b"))
        & (F.col("key_b") != F.col("lead"))
        & ((F.col("root_b") == F.col("lead_root_b")) | (F.col("key") > F.col("key_b")))
        & (F.col("shared") >= least)
        & (F.col("shared_b") >= least)
        & (F.coalesce(*[F.when(band("bands") == band("bands_b"), band("bands")) for band in bands]) == F.col("bucket"))
        & _may_be_near()
    )
    late = late.select(F.col("key").alias("a"), F.col("key_b").alias("b"))
    more = verified(texts, _agreeing(late, nodes), idf)
    return _joined(root, more), star.unionByName(more)


def _joined(root: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``root`` (node, root) after the links ``more`` have joined some of them and single texts."""
    ends = more.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    edges = ends.select(*[F.coalesce(f"root_{end}", end).alias(end) for end in ("a", "b")]).distinct()
    joined = written(components(edges), "joined")
    whole = root.join(joined.select(F.col("node").alias("root"), F.col("root").alias("high")), "root", "left")
    whole = whole.select("node", F.coalesce("high", "root").alias("root"))
    return written(whole.unionByName(joined.join(root.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _spoken():
    return F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` without its text, with class_id, class_key, class_docs and n_build_links.

    Texts are equal or chained by similarity of at least 0.8 inside a class;
    class_id is its smallest doc_id (null if none has one), class_docs its
    number of rows, n_build_links those verified links that were used to build the
    class (links inside one component are not listed) of the row's text to different
    texts. Rows without a word (null, empty, blank) are classes of their own,
    with a null class_key. Result columns whose names ``docs`` already has get
    underscores in front.
    """
    roots, found = links(docs)
    degree = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_build_links"))
    rest = docs.drop("text")
    names = {n: free_name(rest, n) for n in ("class_id", "class_key", "class_docs", "n_build_links")}
    keep = [F.col(f"r.`{c}`") for c in rest.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("r")
    rows = docs.select(row, F.when(_spoken(), text_key()).alias("key"))
    sizes = rows.filter("key is not null").groupBy("key").agg(F.min("r.doc_id").alias("low"), F.count("*").alias("n"))
    sizes = sizes.join(roots.withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
    sizes = sizes.select("key", F.coalesce("root", "key").alias("root"), "low", "n", F.coalesce("n_build_links", F.lit(0)).alias("n_build_links"))
    total = sizes.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_docs"))
    classes = sizes.select("key", "root", "n_build_links").join(total, "root")
    return rows.join(classes, "key", "left").select(
        *keep,
        F.when(F.col("key").isNull(), F.col("r.doc_id")).otherwise(F.col("class_id")).alias(names["class_id"]),
        F.col("root").alias(names["class_key"]),
        F.coalesce("class_docs", F.lit(1)).alias(names["class_docs"]),
        F.coalesce("n_build_links", F.lit(0)).cast("long").alias(names["n_build_links"]),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class of near-duplicates.

    The smallest doc_id stays (null ids last), once even if its row is
    repeated. Rows without a word all stay.
    """
    roots, _ = links(docs)
    rows = docs.filter(_spoken()).select(text_key().alias("key"), "doc_id")
    rows = rows.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("best"))
    first = (F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    gone = written(rows.join(best, "root").filter(~first | (F.col("n") > 1)).select("key", _name().alias("name"), first.alias("first")), "gone")

    key, name, hit = (free_name(docs, n) for n in ("key", "name", "hit"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.select(F.xxhash64("key").alias("h")), "h"))
    hashed = docs.withColumn(hit, F.when(_spoken(), F.xxhash64(text_key())))

    def route(wanted):
        def pick(batches):
            for batch in batches:
                keys = batch.column(batch.num_columns - 1)
                may = passes(bitmap.value, keys.fill_null(0).to_numpy(zero_copy_only=False)) & keys.is_valid().to_numpy(zero_copy_only=False)
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(may == wanted))

        return hashed.mapInArrow(pick, docs.schema)

    # texts of no group pass untouched; of the others, rows equal in text and id are one before they are judged
    judged = route(True).withColumn(key, text_key()).withColumn(name, _name()).dropDuplicates([key, name])
    lost = gone.filter(~F.col("first")).select(F.col("key").alias(key), F.col("name").alias(name)).distinct()
    return route(False).unionByName(judged.join(lost, [key, name], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))


def _name():
    """The id as text; a null one differs from every other."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))

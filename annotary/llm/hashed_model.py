"""Hashed word n-grams and a logistic model trained by FTRL-proximal (operator 8).

Features are single tokens and pairs of neighbours, hashed into 2**18 slots and
scaled to unit length. A bounded, hashed sample of labelled texts trains the
weights with follow-the-regularised-leader updates; a score is the sparse dot
product of a text's features with them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm import text as tx
from annotary.llm.shared import free_name, text_key, written

SLOTS = 1 << 18
TRAIN_ROWS = 4000
EPOCHS = 3


def features(texts):
    """(text index, slot, value) triples of all texts, ordered by text; each text has unit length."""
    hashes, first = tx.tokens(texts)
    pairs, whole = tx.windows(hashes, first, 2)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    slot = np.concatenate([hashes & np.uint64(SLOTS - 1), pairs[whole] & np.uint64(SLOTS - 1)]).astype(np.int64)
    key, count = np.unique(np.concatenate([doc, doc[whole]]) * SLOTS + slot, return_counts=True)
    doc, slot = key // SLOTS, key % SLOTS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    return doc, slot, value / norm[doc]


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` different texts (text, label) chosen by their hash; all of them if there are no more.

    A text counts once, with its largest label, however often it is repeated.
    """
    labelled = labelled.groupBy(text_key().alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    labelled = written(labelled.drop("key"), "labelled")
    share = min(1.0, rows / max(1, labelled.count()))
    return labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))


def packed(labelled: DataFrame):
    """Sampled rows (text, label) as (label, slots, values), in a fixed order, for training on the driver."""

    def pack(batches):
        for batch in batches:
            texts, labels = tx.values(batch.column(0)), batch.column(1).to_pylist()
            for start, stop in tx.pieces(texts):
                doc, slot, value = features(texts[start:stop])
                cut = np.searchsorted(doc, np.arange(stop - start + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array(labels[start:stop], pa.int32()),
                        "slots": [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])],
                        "values": [value[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])],
                    }
                )

    rows = labelled.select("text", F.col("label").cast("int")).mapInArrow(pack, "label int, slots binary, values binary").toArrow()
    found = [
        (y, np.frombuffer(s, np.int32), np.frombuffer(v, np.float32))
        for y, s, v in zip(*(rows[c].to_pylist() for c in ("label", "slots", "values")))
    ]
    found.sort(key=lambda r: (int(r[1].astype(np.int64).sum() * 2654435761 % 1000003), len(r[1]), r[0]))
    return found


class Ftrl:
    """FTRL-proximal for logistic loss on sparse examples."""

    def __init__(self, alpha=2.0, beta=1.0, l1=0.01, l2=0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)  # the last slot is the bias

    def weights(self, slots):
        z, n = self.z[slots], self.n[slots]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, slots, values, y):
        w = self.weights(slots)
        g = (sigmoid(w @ values) - y) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(examples, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all slots and the bias (last). Without examples all are zero."""
    model = Ftrl()
    for _ in range(epochs):
        for y, slots, values in examples:
            model.learn(np.append(slots, SLOTS), np.append(values, 1.0), float(y))
    return model.weights(np.arange(SLOTS + 1)).astype(np.float32)


def scores(texts, weights) -> np.ndarray:
    doc, slot, value = features(texts)
    return sigmoid(np.bincount(doc, value * weights[slot], len(texts)) + float(weights[-1]))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, fold=5, held=0) -> np.ndarray:
    """Weights learned from labelled documents outside the held-out fold of crc32(doc_id).

    A document with several labels counts once, with the largest; rows without
    an id, text or label are not learned from.
    """
    known = (
        labels.select("doc_id", F.col("quality").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != held)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    step = max(1, known.count() // rows)
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)  # about `rows` ids, before their texts move
    labelled = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    return train(packed(sampled(labelled, 2 * rows)))


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, fold=5, held=0) -> DataFrame:
    """Every row of ``docs`` without its text, with held_out, score and predicted (score >= ``cut``).

    Null and empty texts get the bias alone; without any label every score is
    0.5. A row without an id is not held out. Result columns whose names
    ``docs`` already has get underscores in front.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, fold=fold, held=held))
    rest = docs.drop("text")
    score, held_out, predicted = (free_name(rest, n) for n in ("score", "held_out", "predicted"))
    keep = [F.col(f"`{c}`") for c in rest.columns]
    schema = rest.select(*keep).schema.add(score, "double", False)

    def judge(batches):
        for batch in batches:
            texts = tx.values(batch.column(batch.num_columns - 1))
            out = [scores(texts[a:b], weights.value) for a, b in tx.pieces(texts)]
            column = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=schema.names)

    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    return (
        docs.select(*keep, "text")
        .mapInArrow(judge, schema)
        .withColumn(held_out, F.coalesce(crc == held, F.lit(False)))
        .withColumn(predicted, (F.col(f"`{score}`") >= cut).cast("int"))
    )

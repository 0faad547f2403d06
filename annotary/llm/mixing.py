"""Mixing documents to target domain weights with soft membership (operator 6).

A classifier trained on the labels table gives every document posterior
probabilities of the domains. Nonnegative document rates are fitted by
projected least squares so that the expected tokens of each domain, the sum of
rate x tokens x posterior, meet the targets.
"""

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.llm import hashed_model as hm
from annotary.llm import text as tx
from annotary.llm.shared import free_name, written

#: Domains of the labels table, in the order 2 * toxic + quality, and the shares of tokens wanted.
DOMAINS = ("poor", "good", "toxic_poor", "toxic_good")
TARGETS = {"poor": 0.06, "good": 0.88, "toxic_poor": 0.01, "toxic_good": 0.05}
TRAIN_ROWS = 4000
TOLERANCE = 1e-6
EASE, HALVINGS = 1e-10, 12


def fit_domains(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """One weight vector a domain, each against the rest, from about ``rows`` labelled documents.

    A document with several labels counts once, with the largest; rows without
    id, text or label are not learned from.
    """
    known = (
        labels.select("doc_id", (2 * F.col("toxic") + F.col("quality")).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").between(0, len(DOMAINS) - 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    step = max(1, known.count() // rows)
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    labelled = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    examples = hm.packed(hm.sampled(labelled, 2 * rows))
    return np.array([hm.train([(y == k, s, v) for y, s, v in examples]) for k in range(len(DOMAINS))])


def posteriors(texts, weights) -> np.ndarray:
    """(texts, domains) probabilities; equal shares when nothing was learned."""
    doc, slot, value = hm.features(texts)
    one = np.array([hm.sigmoid(np.bincount(doc, value * w[slot], len(texts)) + float(w[-1])) for w in weights]).T
    return one / one.sum(axis=1, keepdims=True)


def measured(texts, weights):
    """Words and posteriors of texts, in pieces."""
    tokens, shares = [np.zeros(0, np.int64)], [np.zeros((0, len(weights)))]
    for start, stop in tx.pieces(texts):
        tokens.append(np.diff(tx.words(texts[start:stop])[1]))
        shares.append(posteriors(texts[start:stop], weights))
    return np.concatenate(tokens), np.concatenate(shares)


def rates(tokens, shares, pulls, floor: float = 0.0) -> np.ndarray:
    """Rates after the steps ``pulls``: 1 less what they sum up to for the row, and not below ``floor``."""
    pull = np.sum(pulls, axis=0) if len(pulls) else np.zeros(shares.shape[1])
    return np.maximum(floor, 1 - tokens * (shares @ pull))


def fit_rates(narrow: DataFrame, targets, floor: float = 0.0):
    """Steps that bring the expected domain tokens of (tokens, shares) rows to ``targets`` shares, see ``fitted``."""
    return fitted(narrow, targets, floor)[0]


def fitted(narrow: DataFrame, targets, floor: float = 0.0):
    """(steps, expected tokens, wanted tokens) of the rates nearest to 1 that meet the targets.

    The rates are the projection of 1 onto the targets and what is not below
    ``floor``, found by Newton steps on one multiplier a domain, each with the
    Gram matrix of the rows above the floor. It goes on until the targets are
    met within ``TOLERANCE`` of all tokens, or as closely as they can be; then
    there is a warning. A document's rate is a function of its own row and the
    steps so far, so nothing but some sums a domain leaves the executors, one
    pass over the rows gives them for all tried lengths of a step.
    """
    n = len(targets)

    def summed(at):
        """Per multiplier of ``at``: dual value without targets, expected tokens, Gram matrix above the floor; all tokens."""
        width = len(at) * (1 + n + n * n) + 1

        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                tokens = batch.column(0).to_numpy().astype(float)
                shares = batch.column(1).flatten().to_numpy().reshape(-1, n)
                rows = tokens[:, None] * shares
                sums = []
                for pull in at:
                    rate = rates(tokens, shares, [pull], floor)
                    free = rows[rate > floor]
                    sums += [[((rate - 1) ** 2 / 2 + rate * (rows @ pull)).sum()], rate @ rows, (free.T @ free).ravel()]
                total += np.concatenate([*sums, [tokens.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{k}" for k in range(width)])

        rows = narrow.mapInArrow(run, ", ".join(f"s{k} double" for k in range(width)))
        row = np.array(rows.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(width)]).first(), float)
        return [(x[0], x[1 : n + 1], x[n + 1 :].reshape(n, n)) for x in row[:-1].reshape(len(at), -1)], row[-1]

    pull = np.zeros(n)
    ((value, got, gram),), total = summed([pull])
    wanted = np.asarray(targets, float) / sum(targets) * total
    pulls: list[np.ndarray] = []
    ease = EASE * np.trace(gram) / n  # keeps the multipliers finite if targets cannot be met
    while total and min(np.abs(got - wanted).max(), np.abs(got - wanted - ease * pull).max()) > TOLERANCE * total:
        step = np.linalg.solve(gram + ease * np.eye(n), got - wanted - ease * pull)
        tried = [pull + step / 2**k for k in range(HALVINGS)]
        results, _ = summed(tried)
        values = [r[0] - wanted @ p - ease / 2 * p @ p for r, p in zip(results, tried)]
        now = value - wanted @ pull - ease / 2 * pull @ pull
        slack = 1e-13 * max(abs(now), total)
        k = next(k for k, v in enumerate(values) if v >= max(values) - slack)
        nearer = np.abs(results[k][1] - wanted - ease * tried[k]).max() < np.abs(got - wanted - ease * pull).max()
        if values[k] <= now + slack and not nearer:
            break  # as near as the precision of the sums allows
        pulls.append(tried[k] - pull)
        pull, (value, got, gram) = tried[k], results[k]
    if total and np.abs(got - wanted).max() > TOLERANCE * total:
        warnings.warn(f"target shares {np.round(wanted / total, 6).tolist()} not met: {np.round(got / total, 6).tolist()}", stacklevel=2)
    return pulls, got, wanted


def soft_mix(docs: DataFrame, labels: DataFrame, targets=TARGETS, floor: float = 0.0) -> DataFrame:
    """Every row and column of ``docs`` with tokens, p_<domain> and rate.

    Null and empty texts have no tokens, and rate 1. Without labels all
    posteriors are equal; targets that no nonnegative rates can meet are met as
    closely as possible, with a warning. No rate is below ``floor``. Repeated rows get equal rates. Result columns whose
    names ``docs`` already has get underscores in front.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(fit_domains(docs, labels))

    def narrow_rows(batches):
        for batch in batches:
            tokens, shares = measured(tx.values(batch.column(0)), weights.value)
            offsets = np.arange(0, len(tokens) * len(DOMAINS) + 1, len(DOMAINS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.ListArray.from_arrays(offsets, shares.ravel())], names=["tokens", "shares"]
            )

    narrow = written(docs.select("text").mapInArrow(narrow_rows, "tokens long, shares array<double>"), "shares")
    pulls = spark.sparkContext.broadcast(fit_rates(narrow, [targets[d] for d in DOMAINS], floor))
    names = [free_name(docs, n) for n in ("tokens", *(f"p_{d}" for d in DOMAINS), "rate")]
    row = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    schema = T.StructType(list(row.schema)).add(names[0], "long", False)
    for name in names[1:]:
        schema = schema.add(name, "double", False)
    place = docs.columns.index("text")

    def rated(batches):
        for batch in batches:
            tokens, shares = measured(tx.values(batch.column(place)), weights.value)
            rate = rates(tokens, shares, pulls.value, floor)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tokens), *[pa.array(np.round(p, 6)) for p in shares.T], pa.array(np.round(rate, 6))],
                names=schema.names,
            )

    return row.mapInArrow(rated, schema)

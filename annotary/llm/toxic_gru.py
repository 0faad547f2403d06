"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 13).

A text is a sequence of tokens, runs of letters and digits or of other marks.
The input of a step joins a vector of the word, if training met it often
enough, with the mean vector of its hashed character trigrams. All overlapping
windows of a text pass through the network, forwards and backwards; attention
pools the states of a window, and the largest window score is the text's.
Training is plain numpy on the driver, on a bounded sample of labelled rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annotary.llm import text as tx
from annotary.llm.shared import free_name, text_key, written

WINDOW, STRIDE = 32, 16  # tokens of a window, and from one window to the next
TRAIN_ROWS = 4000  # labelled texts learned from
TRAIN_BYTES = 10_000_000  # of all of them together
TRAIN_TEXT_BYTES = 16_000  # longer texts are not learned from (they are scored)
WORDS = 4000  # most frequent words of the sample with a vector of their own
LEAST_TEXTS = 5  # texts of the sample a word must occur in to get one
GRAMS = 1 << 11
WORD_SIZE, CHAR_SIZE, STATE = 12, 12, 12
BATCH, RATE, DECAY = 128, 0.01, 1e-4
FIRST_STEPS, LATER_STEPS = 150, 500  # training steps of BATCH windows in either phase
HARD = 3
CHUNK = 2048  # windows that go side by side

# Inputs


class Tokens:
    """Tokens of some texts as distinct words, with the trigrams of each word."""

    def __init__(self, texts):
        data, begin = tx.joined(texts)
        kind = tx._KIND[data]
        cut = np.flatnonzero(np.diff(kind, prepend=255, append=255))
        start, end = cut[:-1], cut[1:]
        keep = kind[start] > 0
        start, end = start[keep], end[keep]
        hashes = tx.range_hash(tx.prefix_hash(data, True), start, end)
        self.first = np.searchsorted(start, begin)
        self.hashes, one, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.grams, self.gram_first = trigrams(data, start[one], end[one])


def trigrams(data, start, end):
    """Slots of the byte trigrams of each range, blanks put around it; A-Z count as a-z."""
    size = end - start + 2
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    padded = np.zeros(first[-1] + 2, np.uint8)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], size)
    body = (inside > 0) & (inside < np.repeat(size, size) - 1)
    source = (np.repeat(start, size) + inside - 1)[body]
    padded[: first[-1]][body] = data[source]
    upper = (padded >= 65) & (padded <= 90)
    padded[upper] += 32
    code = padded[:-2].astype(np.uint64) << np.uint64(16) | padded[1:-1].astype(np.uint64) << np.uint64(8) | padded[2:]
    whole = inside < np.repeat(size, size) - 2
    slots = (tx.mix(code) & np.uint64(GRAMS - 1)).astype(np.int64)[whole]
    return slots, np.concatenate([[0], np.cumsum(size - 2)])


def windows(first):
    """(text, first token, tokens) of all windows: every STRIDE tokens, and one that ends with the text."""
    n = np.diff(first)
    count = np.where(n <= WINDOW, (n > 0).astype(np.int64), 1 + -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    index = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(index * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, first[text] + at, np.minimum(n[text], WINDOW)


# Network


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_parameters(rng, words):
    """Start values. Word row 0 stands for all words without a vector of their own."""
    wide = WORD_SIZE + CHAR_SIZE

    def draw(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    p = {
        "word": (rng.normal(0, 0.3, (words + 1, WORD_SIZE))).astype(np.float32),
        "gram": (rng.normal(0, 0.3, (GRAMS, CHAR_SIZE))).astype(np.float32),
        "att": draw(2 * STATE, 2 * STATE),
        "att_b": np.zeros(2 * STATE, np.float32),
        "att_v": draw(2 * STATE),
        "out": draw(2 * STATE),
        "out_b": np.full(1, -2.0, np.float32),
    }
    for side in ("f", "b"):
        p[f"in_{side}"] = draw(wide, 3 * STATE)  # update, reset, candidate
        p[f"gate_{side}"] = draw(STATE, 2 * STATE)
        p[f"cand_{side}"] = draw(STATE, STATE)
        p[f"bias_{side}"] = np.zeros(3 * STATE, np.float32)
    return p


def word_inputs(p, ids, grams, gram_first):
    """Input vector of each word: its own vector beside the mean of its trigrams'."""
    size = np.diff(gram_first)
    total = np.add.reduceat(p["gram"][grams], gram_first[:-1], axis=0) if len(size) else np.zeros((0, CHAR_SIZE), np.float32)
    return np.concatenate([p["word"][ids], total / size[:, None].astype(np.float32)], axis=1)


def recur(p, side, drive, live, keep=None):
    """States (step, window, STATE) of one direction; ``drive`` holds the inputs' share of the gates.

    A step that is not ``live`` (beyond a short text) leaves the state alone.
    ``keep`` collects what the backward pass needs.
    """
    steps, n, _ = drive.shape
    gate, cand = p[f"gate_{side}"], p[f"cand_{side}"]
    state = np.zeros((n, STATE), np.float32)
    states = np.empty((steps, n, STATE), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        zr = np.tanh((drive[t, :, : 2 * STATE] + state @ gate) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r = zr[:, :STATE], zr[:, STATE:]
        c = np.tanh(drive[t, :, 2 * STATE :] + (r * state) @ cand)
        z = z * live[t][:, None]
        if keep is not None:
            keep.append((t, state, zr, c, z))
        state = state + z * (c - state)
        states[t] = state
    return states


def attend(p, states, live):
    """Attention over the live steps of each window: pooled state, and the parts of its computation."""
    hidden = np.tanh(states @ p["att"] + p["att_b"])
    weight = np.where(live > 0, hidden @ p["att_v"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    return np.einsum("tn,tnd->nd", weight, states), hidden, weight


def drives(p, inputs):
    """Each word's share of the gates, for both directions."""
    return {s: (inputs @ p[f"in_{s}"] + p[f"bias_{s}"]).astype(np.float32) for s in ("f", "b")}


def steps_of(start, size):
    """Token index and liveness (step, window); steps beyond a window repeat its last token."""
    step = np.arange(size.max())[:, None]
    return start + np.minimum(step, size - 1), (step < size).astype(np.float32)


def window_scores(p, shares, word, start, size):
    """Logits of the windows."""
    out = np.empty(len(start), np.float32)
    order = np.argsort(-size, kind="stable")  # short windows together
    for a in range(0, len(order), CHUNK):
        some = order[a : a + CHUNK]
        at, live = steps_of(start[some], size[some])
        w = word[at]
        states = np.concatenate([recur(p, s, shares[s][w], live) for s in ("f", "b")], axis=2)
        pooled, _, _ = attend(p, states, live)
        out[some] = pooled @ p["out"] + p["out_b"]
    return out


def gradients(p, inputs, word, start, size, label, weight):
    """Gradients of the weighted logistic loss over the windows, and of the words' inputs."""
    at, live = steps_of(start, size)
    w = word[at]
    shares = drives(p, inputs)
    kept = {s: [] for s in ("f", "b")}
    states = np.concatenate([recur(p, s, shares[s][w], live, kept[s]) for s in ("f", "b")], axis=2)
    pooled, hidden, att = attend(p, states, live)
    logit = pooled @ p["out"] + p["out_b"]
    d = ((sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
    g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
    dpool = d[:, None] * p["out"]
    dstates = att[:, :, None] * dpool
    datt = np.einsum("tnd,nd->tn", states, dpool)
    dscore = att * (datt - (att * datt).sum(axis=0))
    g["att_v"] = np.einsum("tn,tnd->d", dscore, hidden)
    dhidden = dscore[:, :, None] * p["att_v"] * (1 - hidden * hidden)
    flat = dhidden.reshape(-1, 2 * STATE)
    g["att"], g["att_b"] = states.reshape(-1, 2 * STATE).T @ flat, flat.sum(axis=0)
    dstates = dstates + dhidden @ p["att"].T
    dinputs = np.zeros_like(inputs)
    for k, s in enumerate(("f", "b")):
        own = dstates[:, :, k * STATE : (k + 1) * STATE]
        gate, cand = p[f"gate_{s}"], p[f"cand_{s}"]
        dgate, dcand = np.zeros_like(gate), np.zeros_like(cand)
        ddrive = np.empty(own.shape[:2] + (3 * STATE,), np.float32)
        later = np.zeros(own.shape[1:], np.float32)
        for t, before, zr, c, z in reversed(kept[s]):
            later = later + own[t]
            r = zr[:, STATE:]
            dz = later * (c - before) * live[t][:, None]
            dc = later * z * (1 - c * c)
            dreset = dc @ cand.T
            da = np.concatenate([dz, dreset * before], axis=1) * zr * (1 - zr)
            dcand += (r * before).T @ dc
            dgate += before.T @ da
            ddrive[t, :, : 2 * STATE], ddrive[t, :, 2 * STATE :] = da, dc
            later = later * (1 - z) + dreset * r + da @ gate.T
        g[f"gate_{s}"], g[f"cand_{s}"] = dgate, dcand
        flat = ddrive.reshape(-1, 3 * STATE)
        g[f"bias_{s}"] = flat.sum(axis=0)
        total = np.zeros((len(inputs), 3 * STATE), np.float32)
        np.add.at(total, w.ravel(), flat)
        g[f"in_{s}"] = inputs.T @ total
        dinputs += total @ p[f"in_{s}"].T
    return g, dinputs, logit


class Adam:
    """Adam with decoupled decay and a rate that falls over the steps."""

    def __init__(self, p):
        self.p, self.m, self.v, self.t = p, {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, g):
        self.t += 1
        slow = max(0.05, 1 - self.t / (FIRST_STEPS + LATER_STEPS))
        for k, d in g.items():
            self.m[k] += np.float32(0.1) * (d - self.m[k])
            self.v[k] += np.float32(0.01) * (d * d - self.v[k])
            rate = slow * RATE / (1 - 0.9**self.t)
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8) + slow * RATE * DECAY * self.p[k]).astype(np.float32)


class Model:
    """Known words (sorted hashes) and parameters; small enough to go to every worker."""

    def __init__(self, known, p):
        self.known, self.p = known, p

    def ids(self, hashes):
        at = np.searchsorted(self.known, hashes)
        same = np.append(self.known, np.uint64(0))[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        return np.where(same & (at < len(self.known)), at + 1, 0)

    def scores(self, texts):
        """Largest window score of each text; an empty one gets the score of the bias alone."""
        tokens = Tokens(texts)
        best = np.full(len(texts), float(self.p["out_b"][0]))
        if len(tokens.word):
            shares = drives(self.p, word_inputs(self.p, self.ids(tokens.hashes), tokens.grams, tokens.gram_first))
            text, start, size = windows(tokens.first)
            logit = window_scores(self.p, shares, tokens.word, start, size)
            some = np.flatnonzero(np.diff(tokens.first))
            best[some] = np.maximum.reduceat(logit, np.searchsorted(text, some)).astype(float)
        return sigmoid(best)


def train(examples, seed=13):
    """A model from (label, text) pairs, or None without both labels.

    A label holds for a text, toxicity stands in some window of it. At first
    all windows of toxic texts and twice as many others carry their text's label;
    later rounds learn from the highest-scoring window of each toxic text, from the
    HARD highest of each other text and from random ones of those. In these
    rounds a toxic window weighs the square root of how much rarer it is.
    """
    if len({y for y, _ in examples}) < 2:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([y for y, _ in examples], np.float32)
    tokens = Tokens([t for _, t in examples])
    text, start, size = windows(tokens.first)
    owner = np.repeat(np.arange(len(label)), np.diff(tokens.first))
    spread = np.bincount(np.unique(tokens.word * len(label) + owner) // len(label), minlength=len(tokens.hashes))
    often = np.flatnonzero(spread >= LEAST_TEXTS)
    often = often[np.argsort(-spread[often], kind="stable")][:WORDS]
    model = Model(np.sort(tokens.hashes[often]), None)
    ids = model.ids(tokens.hashes)
    p = model.p = new_parameters(rng, len(model.known))
    adam = Adam(p)
    while adam.t < FIRST_STEPS + LATER_STEPS:
        if adam.t < FIRST_STEPS:
            toxic = np.flatnonzero(label[text] == 1)
            plain = np.flatnonzero(label[text] == 0)
            chosen = np.concatenate([toxic, rng.choice(plain, min(len(plain), 2 * len(toxic)), replace=False)])
            heavy = 1.0
        else:
            shares = drives(p, word_inputs(p, ids, tokens.grams, tokens.gram_first))
            logit = window_scores(p, shares, tokens.word, start, size)
            order = np.lexsort((-logit, text))
            place = np.arange(len(text)) - np.searchsorted(text, text)
            best = order[place < np.where(label[text] == 1, 1, HARD)]
            plain = np.flatnonzero(label[text] == 0)
            chosen = np.concatenate([best, rng.choice(plain, min(len(plain), len(best)), replace=False)])
            heavy = max(1.0, float(np.sqrt((label[text[chosen]] == 0).sum() / max(1, (label[text[chosen]] == 1).sum()))))
        rng.shuffle(chosen)
        left = (FIRST_STEPS if adam.t < FIRST_STEPS else FIRST_STEPS + LATER_STEPS) - adam.t
        for b in range(0, min(len(chosen), left * BATCH), BATCH):
            some = chosen[b : b + BATCH]
            at = start[some][:, None] + np.arange(WINDOW)
            used, local = np.unique(tokens.word[np.minimum(at, (start + size)[some][:, None] - 1)], return_inverse=True)
            local = local.reshape(len(some), WINDOW)
            grams, gram_first = gather(tokens.grams, tokens.gram_first, used)
            own = np.where(rng.random(len(used)) < 0.1, 0, ids[used])  # so that the vector of unknown words is trained
            inputs = word_inputs(p, own, grams, gram_first)
            y = label[text[some]]
            weight = np.where(y == 1, heavy, 1.0)
            g, dinputs, _ = gradients(p, inputs, local.ravel(), np.arange(len(some)) * WINDOW, size[some], y, weight)
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], own, dinputs[:, :WORD_SIZE])
            g["gram"] = np.zeros_like(p["gram"])
            each = np.diff(gram_first)
            np.add.at(g["gram"], grams, np.repeat(dinputs[:, WORD_SIZE:] / each[:, None], each, axis=0))
            adam.step(g)
    return model


def gather(values, first, wanted):
    """The slices of the wanted rows, one after the other, and where each begins."""
    size = np.diff(first)[wanted]
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) + np.repeat(first[wanted] - begin[:-1], size)
    return values[at], begin


# Spark


def examples(docs: DataFrame, labels: DataFrame, fold=5, held=0, rows=TRAIN_ROWS, most=TRAIN_BYTES, longest=TRAIN_TEXT_BYTES):
    """At most ``rows`` (label, text) pairs, half of them toxic if there are as many, and ``most`` bytes, in a fixed order.

    Ids are chosen by hash before any text moves: at most 2 * ``rows`` of each
    label. Equal texts count once, with their largest label.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != held)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [known.filter(f"label = {y}").orderBy(*order).limit(2 * rows) for y in (0, 1)]
    few = written(few[0].union(few[1]), "few")
    found = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, longest)).join(few, "doc_id")
    found = found.groupBy(text_key().alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    found = written(found, "examples")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    picked = found.select("key", "label", F.octet_length("text").alias("size"), rank.alias("rank"))
    # toxic texts first take up to half of the places; one window holds at most 4 * rows narrow rows
    picked = picked.withColumn("place", F.row_number().over(Window.orderBy("rank", F.desc("label"))))
    picked = picked.withColumn("sum", F.sum("size").over(Window.orderBy("place")))
    picked = picked.filter((F.col("place") <= rows) & (F.col("sum") <= most)).select("key", "place")
    got = found.join(picked, "key").select("place", "label", F.col("text").cast("binary").alias("text")).toArrow()
    return [(y, t) for _, y, t in sorted(zip(got["place"].to_pylist(), got["label"].to_pylist(), got["text"].to_pylist()))]


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, fold=5, held=0) -> DataFrame:
    """Every row of ``docs`` without its text, with held_out, score and predicted (score >= ``cut``).

    Null and empty texts, and texts of blanks, get the score of the bias alone;
    repeated rows get equal scores; long texts are read whole. A row without an id is not
    held out. Labels that are null, neither 0 nor 1, or without an id are not
    learned from; without both labels every score is 0.5. Result columns
    whose names ``docs`` already has get underscores in front.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(examples(docs, labels, fold, held)))
    rest = docs.drop("text")
    score, held_out, predicted = (free_name(rest, n) for n in ("score", "held_out", "predicted"))
    keep = [F.col(f"`{c}`") for c in rest.columns]
    schema = rest.select(*keep).schema.add(score, "double", False)

    def judge(batches):
        for batch in batches:
            texts = tx.values(batch.column(batch.num_columns - 1))
            if model.value is None:
                out = [np.full(len(texts), 0.5)]
            else:
                out = [model.value.scores(texts[a:b]) for a, b in tx.pieces(texts)]
            column = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=schema.names)

    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    return (
        docs.select(*keep, "text")
        .mapInArrow(judge, schema)
        .withColumn(held_out, F.coalesce(crc == held, F.lit(False)))
        .withColumn(predicted, (F.col(f"`{score}`") >= cut).cast("int"))
    )

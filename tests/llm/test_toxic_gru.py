import numpy as np

from annotary.llm import text as tx
from annotary.llm import toxic_gru as tg
from tests.conftest import SF_DIR

TEXTS = [b"the quick brown fox jumps!", b"an IDIOT went ## home now", b"x", "é ü".encode()]


def parts(seed=0, words=5):
    rng = np.random.default_rng(seed)
    tokens = tg.Tokens(TEXTS)
    p = {k: v.astype(np.float64) for k, v in tg.new_parameters(rng, words).items()}
    return rng, tokens, p, np.arange(len(tokens.hashes)) % (words + 1)


def test_gradients_equal_differences():
    rng, tokens, p, ids = parts()
    _, start, size = tg.windows(tokens.first)
    inputs = tg.word_inputs(p, ids, tokens.grams, tokens.gram_first)
    y, w = np.array([0, 1, 1.0, 0]), np.array([1, 2, 1.0, 1])

    def loss(p, inputs):
        z = tg.gradients(p, inputs, tokens.word, start, size, y, w)[2].astype(float)
        return (w * (np.log1p(np.exp(z)) - y * z)).mean()

    g, dinputs, _ = tg.gradients(p, inputs, tokens.word, start, size, y, w)
    for name, d in [*g.items(), ("inputs", dinputs)]:
        base = inputs if name == "inputs" else p[name]
        at, e = tuple(rng.integers(0, s) for s in base.shape), 1e-2
        old, found = base[at], []
        for step in (e, -e):
            base[at] = old + step
            found.append(loss(p, inputs))
        base[at] = old
        assert abs(d[at] - (found[0] - found[1]) / (2 * e)) < 1e-3 * max(1, abs(d[at]))


def plain_score(model, text):
    """The network over one window after the other, one step after the other."""
    p, tokens = model.p, tg.Tokens([text])
    word = tokens.word
    if not len(word):
        return 1 / (1 + np.exp(-p["out_b"][0]))
    ids = model.ids(tokens.hashes)
    x = []
    for k in word:
        grams = tokens.grams[tokens.gram_first[k] : tokens.gram_first[k + 1]]
        x.append(np.concatenate([p["word"][ids[k]], p["gram"][grams].mean(axis=0)]))
    starts = list(range(0, max(1, len(x) - tg.WINDOW + 1), tg.STRIDE))
    if len(x) > tg.WINDOW and starts[-1] != len(x) - tg.WINDOW:
        starts.append(len(x) - tg.WINDOW)
    best = -np.inf
    for s in starts:
        some, states = x[s : s + tg.WINDOW], {}
        for side in ("f", "b"):
            h, states[side] = np.zeros(tg.STATE), {}
            order = range(len(some)) if side == "f" else range(len(some) - 1, -1, -1)
            for t in order:
                a = some[t] @ p[f"in_{side}"] + p[f"bias_{side}"]
                z, r = np.split(1 / (1 + np.exp(-(a[: 2 * tg.STATE] + h @ p[f"gate_{side}"]))), 2)
                c = np.tanh(a[2 * tg.STATE :] + (r * h) @ p[f"cand_{side}"])
                h = states[side][t] = h + z * (c - h)
        both = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(some))])
        e = np.exp(np.tanh(both @ p["att"] + p["att_b"]) @ p["att_v"])
        best = max(best, (e / e.sum()) @ both @ p["out"] + p["out_b"][0])
    return 1 / (1 + np.exp(-best))


def test_scores_equal_a_step_by_step_network():
    _, tokens, p, _ = parts(words=3)
    model = tg.Model(np.sort(tokens.hashes[:3]), {k: v.astype(np.float32) for k, v in p.items()})
    long = b" ".join(b"word%d, again" % (k % 40) for k in range(150))
    texts = [*TEXTS, b"", b"  \n", long, b"a " * 32, b"a " * 33]
    got = model.scores(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)


def test_trigrams_of_words():
    data = np.frombuffer(b"Abc d", np.uint8)
    slots, first = tg.trigrams(data, np.array([0, 4]), np.array([3, 5]))
    want = []
    for gram in (b"\0ab", b"abc", b"bc\0", b"\0d\0"):
        code = np.uint64(gram[0] << 16 | gram[1] << 8 | gram[2])
        want.append(int(tx.mix(np.array([code]))[0]) % tg.GRAMS)
    assert slots.tolist() == want and first.tolist() == [0, 3, 4]


def test_learns_held_out_toxicity(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.1')}/labels.parquet")
    held = docs.join(labels, "doc_id").filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0")
    model = tg.train(tg.examples(docs, labels))
    rows = [(r.toxic, r.text.encode()) for r in held.select("toxic", "text").collect()]
    got = np.concatenate([model.scores([t for _, t in rows][a:b]) for a, b in tx.pieces([t for _, t in rows])])
    toxic = np.array([y for y, _ in rows]) == 1
    assert (got[toxic] >= 0.5).mean() > 0.85 and (got[~toxic] >= 0.5).mean() < 0.05


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(tg, "FIRST_STEPS", 5)
    monkeypatch.setattr(tg, "LATER_STEPS", 5)
    rows = [(1, "good text here"), (2, "you idiot"), (3, None), (None, ""), (1, "good text here"), (4, "word " * 100_000), (5, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS predicted", "7 AS label")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, 1), (9, None), (4, 5)], "doc_id long, toxic int")
    got = tg.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r._predicted in (0, 1) and r.predicted == "x" for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    assert len({r.score for r in got if r.doc_id in (3, 5, None)}) == 1
    assert {r.score for r in tg.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert tg.score_toxicity(docs.limit(0), labels).count() == 0


def test_copies_are_learned_from_once(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id < 2900 THEN 'same text' ELSE 'text ' || id END AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "int(id % 50 = 0) AS toxic")
    got = tg.examples(docs, labels, rows=500)
    assert len(got) == len({t for _, t in got}) <= 500

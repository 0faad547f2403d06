import hashlib
import random
from collections import Counter

from annotary.llm import repeats as rp


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    n = rp.LENGTH
    count = Counter(r[k : k + n] for r in raws for k in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - n + 1):
            if count[r[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_spans string")
    rows = sorted(rp.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert all(r.n_spans == "x" for r in rows)
    assert [(r.n_bytes, r.n_removed, r._n_spans, r.kept_sha256) for r in rows] == brute(texts)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))


def test_shared_passages_copies_and_edits(spark):
    rng = random.Random(2)
    passage, base = words(rng, 150), words(rng, 400)
    texts = [words(rng, 300) for _ in range(4)]
    texts += [words(rng, 60) + passage + words(rng, 60) for _ in range(3)]
    texts += [passage[5:410], passage[40 : 40 + 399], passage[3:403] + "#", base, base]
    for _ in range(8):  # near copies: a changed byte at a random place
        at = rng.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1 :])
    check(spark, texts)


def test_periodic_short_and_empty_texts(spark):
    rng = random.Random(4)
    line = words(rng, 12) + "\n"
    texts = [None, "", "a" * 399, "a" * 400, "a" * 900, "ab" * 700, line * 30, line * 9 + words(rng, 90) + line * 12, "b" * 399 + "c", None, ""]
    check(spark, texts)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(6)
    long = words(rng, 900)
    monkeypatch.setattr(rp, "CHUNK", 700)
    check(spark, [long, long[1000:2600], words(rng, 50) + long[2000:2390], long[333:733]])


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rp.remove_repeats(empty).count() == 0
    docs = spark.createDataFrame([(None, "z" * 450), (None, "z" * 450)], "doc_id long, text string")
    assert [r.n_removed for r in rp.remove_repeats(docs).collect()] == [450, 450]

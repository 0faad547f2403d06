import math
import random

import numpy as np

from annotary.llm import near_dedup as nd
from annotary.llm import text as tx
from annotary.llm.shared import components

IDF = nd.Idf(np.zeros(0, np.uint64), np.zeros(0))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Smallest id of the component of each row, by plain Jaccard similarity."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return {rows[k][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(k)) for k in range(len(rows))}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force_with_a_crowd_of_near_copies(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = rng.choices(vocabulary, k=200)
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 120)))) for k in range(60)]
    rows += [(100 + k, edited(rng, base, rng.choice([0, 1, 2, 3, 15]))) for k in range(60)]
    rows += [(300 + k, " ".join(base)) for k in range(10)] + [(400, rows[3][1]), (401, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    want = brute_classes(rows)
    assert sum(got[k] != want[k] for k in want) <= 1  # a similarity right at the threshold may fall either way
    kept = nd.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = random.Random(1)
    words = [f"v{k}" for k in range(400)]
    texts = [" ".join(words).encode(), edited(rng, words, 8).encode()]
    doc, ids, weight = nd.weighted(texts, IDF)
    one, two = ((ids[doc == k], weight[doc == k]) for k in (0, 1))
    want = nd.similarity(one, two)
    a, b = dict(zip(*one)), dict(zip(*two))
    plain = sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
    assert math.isclose(want, plain)
    hits = []
    for shift in range(20):
        samples = nd.consistent_samples(doc, tx.mix(ids + np.uint64(shift)), weight, 2)
        hits.append((samples[:, 0] == samples[:, 1]).mean())
    assert abs(np.mean(hits) - want) < 0.06


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "two words", "a"), (5, "two words", "a"), (5, "two words", "a"),
            (None, "two words", "b"), (None, "alone here", "b"), (6, "x " * 60_000, "b"), (7, "x " * 60_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = nd.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r._class_id) for r in got if r.doc_id in (1, 2, 3)] == [(k, k) for k in (1, 2, 3)]
    assert {r._class_id for r in got if r.doc_id in (4, 5)} == {4} and {r._class_id for r in got if r.doc_id in (6, 7)} == {6}
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, ""), (2, ""), (3, " \n"), (4, "two words"), (0, "alone here"), (6, "x " * 60_000)]
    )
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"a{k:02d}", f"a{k + 1:02d}") for k in range(12)] + [("c", f"d{k}") for k in range(5)] + [("x", "x")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"a{k:02d}"] for k in range(13)} == {"a00"} and {got[f"d{k}"] for k in range(5)} == {"c"} and "x" not in got


def test_links_are_named_for_what_they_are(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    got = nd.near_duplicates(docs)
    assert "n_build_links" in got.columns and "n_links" not in got.columns and [r.n_build_links for r in got.collect()] == [0]


def test_a_null_id_is_not_an_empty_one(spark):
    docs = spark.createDataFrame(
        [("", "one text here"), (None, "one text here"), (None, "one text here"), (None, "other words"), (None, "other words"), ("b", None)],
        "doc_id string, text string",
    )
    kept = nd.keep_one(docs).collect()
    assert sorted(r.text or "" for r in kept) == ["", "one text here", "other words"]
    assert {r.text: r.doc_id for r in kept} == {"one text here": "", "other words": None, None: "b"}


def test_linked_groups_are_joined_before_strays_are_compared(spark):
    """Two groups around texts that differ by a sixth, with texts between them: one class."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    far = words[:280] + [f"x{k}" for k in range(20)]
    middle = words[:290] + [f"x{k}" for k in range(10, 20)]
    rows = [(k, edited(rng, words, 2)) for k in range(40)] + [(100 + k, edited(rng, far, 2)) for k in range(40)]
    rows += [(200 + k, edited(rng, middle, 1)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_a_crowd_of_strays_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Texts of three edits are near few others of their crowd; the rest is ruled out before pairs are made."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, edited(rng, words, 1 if k % 3 else 3)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, write = [], nd.written

    def counted(df, name):
        table = write(df, name)
        if name == "pairs":
            made.append(table.count())
        return table

    monkeypatch.setattr(nd, "written", counted)
    found = nd.links(docs)[1]
    few, links = made[1], {tuple(sorted((r.a, r.b))) for r in found.collect()}
    monkeypatch.setattr(nd, "CROWD", 10**9, raising=False)
    assert {tuple(sorted((r.a, r.b))) for r in nd.links(docs)[1].collect()} == links
    assert few < made[3] / 2, made


def test_difference_of_weighted_sets():
    a = (np.array([1, 2, 5], np.uint64), np.array([1.0, 2.0, 1.5]))
    b = (np.array([2, 5, 9], np.uint64), np.array([1.0, 1.5, 1.2]))
    away, least, bits = nd.difference(a, b)
    assert math.isclose(away, 3.2) and least == 1.0 and sum(int(w).bit_count() for w in bits) == 3
    assert nd.difference(a, a)[:2] == (0.0, 1.0) and not nd.difference(a, a)[2].any()

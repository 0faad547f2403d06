import random

import numpy as np

from annotary.llm import language as lang
from tests.conftest import SF_DIR


def brute_phrases(text, sample):
    count, at = 0, 0
    for begin in range(0, len(text), lang.STRIP):
        part, at = text[begin : begin + lang.STRIP], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at : at + n + 1] in sample:
                n += 1
            count, at = count + 1, at + n
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(5)
    samples = {"x": "".join(rng.choices("abc ", k=300)), "y": "".join(rng.choices("bcd ", k=200)), "z": "aaaa"}
    parser = lang.CrossParser(samples)
    texts = ["", "a", "?", "abca", "".join(rng.choices("abcd ?", k=5000)), samples["x"][40:90] + "ddd", "a" * 3000]
    got = parser.phrases(texts)
    for t, row in zip(texts, got):
        assert list(row) == [brute_phrases(t, samples[name]) for name in sorted(samples)]


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = lang.identify(docs, lang.learn(docs)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(1, "der die das und", "de"), (3, "the of and to", "en"), (2, "the the", None), (5, None, "en"), (6, "123 !?", "en"),
            (7, "", "de"), (None, "the of", "en"), (1, "der die das und", "de"), (8, "und das " * 40_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5D AS score")
    parser = lang.learn(docs)
    got = lang.identify(docs, parser).collect()
    assert len(got) == len(rows) and got[0].score == 0.5
    pred = {(r.doc_id, r.lang): r.lang_pred for r in got}
    assert pred[(5, "en")] == pred[(6, "en")] == pred[(7, "de")] == lang.UNKNOWN and pred[(8, "de")] == "de"
    kept = lang.known_language(docs, parser)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, None}
    empty = docs.limit(0)
    assert lang.identify(empty, lang.learn(empty)).count() == 0
    assert lang.known_language(docs, lang.learn(empty)).count() == len(rows)  # nothing learned, nothing rejected


def test_automaton_knows_exactly_the_substrings():
    table = lang.suffix_automaton([1, 2, 1, 1, 2], 4)

    def known(word):
        state = 0
        for c in word:
            state = table[state, c]
            if state < 0:
                return False
        return True

    inside = {(1, 2, 1, 1, 2)[a:b] for a in range(5) for b in range(a + 1, 6)}
    assert all(known(w) == (w in inside) for n in (1, 2, 3) for w in np.ndindex(*[4] * n))


def test_copies_are_learned_from_once_and_only_letters_count(spark):
    rows = [(k, "en", "the cat sat on the mat") for k in range(3000)] + [(k, "de", "der hund und die katze") for k in range(5000, 5020)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    parser = lang.learn(docs)
    assert sorted(parser.languages) == ["de", "en"]
    names, _ = parser.predict(["½ ² ①", "the mat", "٣ 42", "ª", None])
    assert list(names) == ["und", "en", "und", names[3], "und"] and names[3] != "und"

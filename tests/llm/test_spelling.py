import random

import pytest

from annotary.llm import catalog, spelling
from tests.check_oracle import compare, connect
from tests.conftest import SF_DIR


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("letters", ["ab", "abcé", "aÿ"])
def test_a_shard_finds_every_word_one_edit_apart(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(70)})
        got = set()
        for reverse in (False, True):
            got |= {(a, b) for a, b, _ in spelling.search_shard(words, [1] * len(words), [True] * len(words), reverse)}
        assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_dealt_halves_lose_no_pair(spark):
    """One first half holds most words, so its words are dealt over many shards."""
    rng = random.Random(4)
    words = {"zzzz" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(300)}
    words |= {"".join(rng.choice("abz") for _ in range(7)) for _ in range(60)} | {"y" * 3000, "y" * 3001}
    table = spark.createDataFrame([(w, k + 1) for k, w in enumerate(sorted(words))], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_words(table, shard_chars=1500, key_chars=400).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_forms_and_roots(spark):
    counts = {"runnnig": 2, "runnnin": 2, "running": 30, "runnings": 400, "ranning": 3, "lonely": 9, "runninga": 400}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.spelling_forms(table).collect()}
    assert got["ranning"] == ("running", "runninga", 1, 30)  # of equal forms the smaller: runninga before runnings
    assert got["running"] == ("runninga", "runninga", 3, 400)
    assert got["runnings"] == (None, "runnings", 2, None)
    assert got["runnnig"] == (None, "runnnig", 1, None)
    assert got["lonely"] == (None, "lonely", 0, None)


def test_query_equals_sql(spark):
    query = catalog.load()["op11_spelling_variants"]
    assert compare(query.run(spark, SF_DIR), connect(SF_DIR), query.sql) is None


def test_edge_rows(spark):
    rows = [(1, None), (None, "Schöning schöning SCHöning"), (2, ""), (3, "éééééééé éééééééé ×÷×÷×÷×"), (3, "éééééééé"), (4, "a" * 50_000 + " 1 " + "a" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    got = {r.word: r.n for r in spelling.word_counts(docs, spoil=0).collect()}
    assert got == {"schöning": 3, "éééééééé": 3, "a" * 50_000: 2}
    assert {r.n_near for r in spelling.spelling_variants(docs, spoil=0).collect()} == {0}
    none = spelling.spelling_variants(docs.limit(0))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]

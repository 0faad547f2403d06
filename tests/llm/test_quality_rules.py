import itertools
import re

import pytest

from annotary.llm import catalog, quality_rules as q
from tests.check_oracle import compare, connect
from tests.conftest import SF_DIR

LONG = " ".join(f"the w{k} of x{k}" for k in range(40))
TEXTS = [
    None, "", " \n\t ", "one", "a a a a a a", "é é é\x1cx\x85y", "line\nline\n line\n\n \nline", "a # b *** <>|&%$", LONG,
    LONG.upper(), "x " * 400, LONG + "\n" + LONG, "\n".join(["- the and of point"] * 3 + [LONG]), ("word " * 60 + "\n") * 200,
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 3000 else None
    if covered is None:
        seen = {}
        for k, g in enumerate(grams):
            seen.setdefault(g, []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_columns_equal_brute_force_and_clashes_are_kept(spark):
    rows = [(k, t, -1, "s") for k, t in enumerate(TEXTS)] + [(None, "a b", 7, None), (0, None, -1, "s"), (0, None, -1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, source string")
    got = q.quality_cascade(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(TEXTS):
        r, want = by_id[k], brute(t)
        assert (r._n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and r.n_words == -1
    assert by_id[8].kept and not by_id[9].kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality_cascade(docs).collect() == []


def test_order_follows_rejection_per_cost_and_never_changes_the_verdict():
    estimates = {"symbols": (1.0, 0.1), "upper_case": (0.1, 0.1), "few_letters": (0.1, 0.0)}
    names = [r.name for r in q.plan(estimates, q.RULES[:3])]
    assert names == ["upper_case", "symbols", "few_letters"]
    for text in TEXTS:
        view = q.View((text or "").encode())
        verdicts = {q.verdict(view, order) is None for order in itertools.permutations(q.RULES[:5])}
        assert len(verdicts) == 1


def test_query_equals_sql(spark):
    query = catalog.load()["op1_quality_cascade"]
    assert compare(query.run(spark, SF_DIR), connect(SF_DIR), query.sql) is None


@pytest.mark.parametrize("name", list(catalog.load()))
def test_every_query_is_named_after_its_operator(name):
    assert re.fullmatch(r"op([1-9]|10)_[a-z0-9_]+", name)

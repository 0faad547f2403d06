"""Quality rules as a short-circuit cascade (operator 1).

Rules are independent tests on one text. Their cost (seconds a text) and
selectivity (share of texts rejected) are estimated on a hashed sample; the
cascade then runs them by rejection per cost and stops at the first rejection.
The order changes the work, never the verdict.
"""

import time
from collections import Counter
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotary.llm import text as tx
from annotary.llm.shared import free_name

SAMPLE_ROWS = 2000
_SYMBOLS = b"#*$%&|<>"
_ANY_SYMBOL = np.zeros(256, bool)
_ANY_SYMBOL[list(_SYMBOLS)] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Words of which ordinary prose in the covered languages has some.
STOPWORDS = frozenset(
    "the be to of and that have with is was for la le les de des et un une en est der die das und ein "
    "eine von zu ist el los que y las por del se".encode().split()
)


class View:
    """One text; what several rules need is computed once."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.words = raw.split()
        self.lines = [line for line in raw.split(b"\n") if line.split()]
        self._array = None

    @property
    def array(self):
        if self._array is None:
            self._array = np.frombuffer(self.raw, np.uint8)
        return self._array

    @property
    def n_word_chars(self):
        return sum(map(len, self.words)) or 1

    def base(self):
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        a = self.array
        chars = int(((a & 0xC0) != 0x80).sum()) - int(tx.SPACE[a].sum())
        return len(self.words), chars, int(_ANY_SYMBOL[a].sum()), len(self.lines) - len(set(self.lines)), repeat_words(self.words)


def repeat_words(words) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``test`` says so."""

    name: str
    test: Callable[[View], bool]


def _symbols(v):
    return int(_ANY_SYMBOL[v.array].sum()) > 0.1 * len(v.words)


def _upper(v):
    letters = int(_LETTERS[v.array].sum())
    return letters > 0 and int(_UPPER[v.array].sum()) > 0.5 * letters


def _no_letter(v):
    return int(_LETTERS[v.array].sum()) < 0.6 * v.n_word_chars


def _word_length(v):
    return bool(v.words) and not 2 <= v.n_word_chars / len(v.words) <= 16


def _same_lines(v):
    return len(v.lines) - len(set(v.lines)) > 0.3 * len(v.lines)


def _one_word(v):
    if len(v.words) < 50:
        return False
    return max(Counter(v.words).values()) > 0.3 * len(v.words)


def _no_stopword(v):
    return len(v.words) >= 50 and sum(w in STOPWORDS for w in map(bytes.lower, v.words)) < 2


def _bullets(v):
    marked = sum(line.lstrip()[:1] in (b"-", b"*", b"|") or line.lstrip().startswith("•".encode()) for line in v.lines)
    return len(v.lines) > 2 and marked > 0.9 * len(v.lines)


def _ellipsis(v):
    cut = sum(line.rstrip().endswith((b"...", "…".encode())) for line in v.lines)
    return len(v.lines) > 2 and cut > 0.3 * len(v.lines)


RULES = (
    Rule("symbols", _symbols),
    Rule("upper_case", _upper),
    Rule("few_letters", _no_letter),
    Rule("word_length", _word_length),
    Rule("same_lines", _same_lines),
    Rule("one_word", _one_word),
    Rule("no_stopword", _no_stopword),
    Rule("bullets", _bullets),
    Rule("ellipsis", _ellipsis),
)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def estimate(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS):
    """Seconds a text and rejected share of every rule, on a hashed sample of about ``sample_rows`` texts.

    Executors time the rules; one row per rule and partition is summed. An
    empty table gives zero for both.
    """
    total = docs.count()
    step = max(1, total // sample_rows)
    column = F.col(f"`{text}`")
    sample = docs.select(column.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)

    def measure(batches):
        spent, out, n = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for raw in tx.values(batch.column(0)):
                view, n = View(raw), n + 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    out[k] += bool(rule.test(view))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict(
            {"rule": [r.name for r in rules], "spent": spent, "rejected": out, "n": [n] * len(rules)}
        )

    rows = (
        sample.mapInArrow(measure, "rule string, spent double, rejected long, n long")
        .groupBy("rule")
        .agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n"))
        .collect()
    )
    return {r.rule: (r.spent / max(1, r.n), r.rejected / max(1, r.n)) for r in rows}


def plan(estimates, rules=RULES):
    """The rules by rejections per second of work, best first; ties by name."""
    def worth(rule):
        cost, share = estimates.get(rule.name, (0.0, 0.0))
        return (-share / max(cost, 1e-9), rule.name)

    return tuple(sorted(rules, key=worth))


def verdict(view: View, ordered) -> str | None:
    """Name of the first rule that rejects the text, or None."""
    return next((rule.name for rule in ordered if rule.test(view)), None)


def quality_cascade(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of ``docs`` without its text, with base statistics and the cascade's verdict.

    A null or empty text has no words and fails the base test. Repeated rows
    and ties stay as they are: each row is judged alone. Result columns whose
    names ``docs`` already has get underscores in front.
    """
    ordered = plan(estimate(docs, rules, text, sample_rows), rules)
    keep = [c for c in docs.columns if c != text]
    names = [free_name(docs.drop(text), n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name in names[:5]:
        schema = schema.add(name, "long", False)
    for name in names[5:]:
        schema = schema.add(name, "boolean", False)

    def judge(batches):
        for batch in batches:
            rows = []
            for raw in tx.values(batch.column(batch.num_columns - 1)):
                view = View(raw)
                stats = view.base()
                failed = base_failed(stats[0], stats[4])
                rows.append((*stats, failed, not failed and verdict(view, ordered) is None))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keep))]
                + [pa.array(columns[k], pa.int64() if k < 5 else pa.bool_()) for k in range(7)],
                names=[*keep, *names],
            )

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(judge, schema)

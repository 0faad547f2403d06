"""Language identification by cross-parsing (operator 4).

Labelled text of each language becomes a suffix automaton. A text is parsed
greedily into the longest pieces each automaton knows; the language that needs
the fewest phrases per character is the nearest one.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.llm.shared import free_name, text_key

TRAIN_CHARS = 24_000
TRAIN_ROWS = 60
STRIP = 2048  # characters parsed in step; each strip starts a new phrase
PIECE_CHARS = 1 << 19
UNKNOWN = "und"
_MARKS = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Lower case, with every run of other characters than letters as one blank."""
    return _MARKS.sub(" ", text.lower())


def suffix_automaton(text, n_symbols: int) -> np.ndarray:
    """Transition table (state, symbol) of all substrings of ``text``; 0 is the start, -1 no way on."""
    step, link, longest, last = [{}], [-1], [0], 0
    for c in text:
        state = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    table = np.full((len(step), n_symbols), -1, np.int32)
    for state, ways in enumerate(step):
        table[state, list(ways)] = list(ways.values())
    return table


class CrossParser:
    """Automata of all languages over one alphabet; symbol 0 stands for unseen characters."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        alphabet = sorted(set("".join(samples.values())))
        self.codes = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(alphabet):
            self.codes[ord(c)] = k + 1
        n = len(alphabet) + 1
        # A negative entry begins a phrase with this character: at the start, and where there is no way on.
        self.tables = []
        for name in self.languages:
            table = suffix_automaton(self.encode(samples[name]).tolist(), n)
            start = np.maximum(table[0], 0)
            begins = table < 0
            begins[0] = True
            self.tables.append((np.where(begins, ~start, table).astype(np.int32).ravel(), n))

    def encode(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts) -> np.ndarray:
        """Phrases of each text in each language."""
        codes = [self.encode(t) for t in texts]
        strips = [(k, c[a : a + STRIP]) for k, c in enumerate(codes) for a in range(0, len(c), STRIP)]
        strips.sort(key=lambda s: -len(s[1]))
        size = np.array([len(s) for _, s in strips])
        owner = np.array([k for k, _ in strips], int)
        out = np.zeros((len(texts), len(self.languages)))
        if not strips:
            return out
        grid = np.zeros((int(size[0]), len(strips)), np.int32)
        for column, (_, s) in enumerate(strips):
            grid[: len(s), column] = s
        alive = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for k, (table, n) in enumerate(self.tables):
            state = np.zeros(len(strips), np.int32)
            count = np.zeros(len(strips), np.int64)
            for row, live in zip(grid, alive):
                to = table[state[:live] * n + row[:live]]
                ends = to < 0
                count[:live] += ends
                state[:live] = np.where(ends, ~to, to)
            out[:, k] = np.bincount(owner, count, len(texts))
        return out

    def predict(self, texts):
        """Language and score (0 to 1) of each text; UNKNOWN with 0 for null and letterless ones.

        The score is the best language's share of the sum, over languages, of
        characters per phrase squared. Equal languages go by name.
        """
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        real = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if not real or not self.languages:
            return names, scores
        parts, size, start = [], 0, 0
        clean = [folded(texts[k]) for k in real]
        for k, t in enumerate(clean):
            if k > start and size + len(t) > PIECE_CHARS:
                parts.append(self.phrases(clean[start:k]))
                start, size = k, 0
            size += len(t)
        parts.append(self.phrases(clean[start:]))
        fit = 1 / np.concatenate(parts) ** 2
        best = fit.argmax(axis=1)
        names[real] = np.array(self.languages, object)[best]
        scores[real] = fit[np.arange(len(real)), best] / fit.sum(axis=1)
        return names, scores


def learn(docs: DataFrame, fold=4, held=2, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> CrossParser:
    """Automata from at most ``rows`` labelled texts and ``chars`` characters a language.

    Texts of the held-out fold of crc32(doc_id) and rows without language, id
    or text are not learned from. Different texts are taken in the order of a
    hash, each once, however often it is repeated.
    """
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc != held))
    labelled = labelled.select("lang", text_key().alias("key"), F.substring("text", 1, chars).alias("text"))
    first = Window.partitionBy("lang").orderBy("key")
    known = labelled.select("lang", "key").distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= rows)
    # copies of a text fold before anything is collected
    texts = labelled.join(F.broadcast(known), ["lang", "key"]).groupBy("lang", "rank").agg(F.first("text").alias("text")).collect()
    samples: dict[str, str] = {}
    for row in sorted(texts, key=lambda r: (r.lang, r.rank)):
        have = samples.get(row.lang, "")
        if len(have) < chars:
            samples[row.lang] = (have + " " + folded(row.text))[:chars]
    return CrossParser(samples)


def identify(docs: DataFrame, parser: CrossParser, fold=4, held=2, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs``, without its text unless ``keep_text``, with held_out, lang_pred and score.

    Null texts and texts without a letter (Unicode category L) are UNKNOWN with score 0, as is every
    text if nothing was learned. A row without an id is not held out. Repeated
    rows get equal answers. Result columns whose names ``docs`` already has get
    underscores in front.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)
    order = [c for c in docs.columns if c != "text"]
    row = docs.select(*[F.col(f"`{c}`") for c in order], "text")
    name, score, held_out = (free_name(docs, n) for n in ("lang_pred", "score", "held_out"))
    stop = len(order) + keep_text
    schema = T.StructType(row.schema.fields[:stop]).add(name, "string", False).add(score, "double", False)

    def judge(batches):
        for batch in batches:
            names, scores = model.value.predict(batch.column(len(order)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:stop], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names
            )

    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    return row.mapInArrow(judge, schema).withColumn(held_out, F.coalesce(crc == held, F.lit(False)))


def known_language(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told; all rows if nothing was learned.

    Rejected are null and letterless texts, and texts that fit no language
    better than the others (one per cent above an equal share).
    """
    if not parser.languages:
        return docs
    name, score = (free_name(docs, n) for n in ("lang_pred", "score"))
    told = identify(docs, parser, keep_text=True)
    least = 1.01 / len(parser.languages) if len(parser.languages) > 1 else 0.0
    kept = told.filter((F.col(f"`{name}`") != UNKNOWN) & (F.col(f"`{score}`") >= least))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

"""The registered queries of the text operators, with their SQL."""

from annotary.llm import queries_corpus, queries_text, queries_toxic, queries_vectors, queries_words  # noqa: F401
from annotary.llm.registry import CATALOG


def load():
    return CATALOG

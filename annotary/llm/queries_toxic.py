"""Query on toxic texts."""

from annotary.llm import toxic_gru
from annotary.llm.registry import query, table


@query()
def op13_toxic_gru(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxic_gru.score_toxicity(docs, table(spark, sf_dir, "labels"))

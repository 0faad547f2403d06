"""Queries on embeddings."""

from annotary.llm import whitening
from annotary.llm.registry import query, table


@query()
def op12_blockmatrix_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

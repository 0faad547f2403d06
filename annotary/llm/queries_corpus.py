"""Queries that compare texts with each other or with other tables."""

from annotary.llm import decontamination, mixing, near_dedup, repeats
from annotary.llm.registry import query, table


@query()
def op6_soft_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.soft_mix(docs.select("doc_id", "source", "text"), table(spark, sf_dir, "labels")).drop("text")


@query()
def op7_icws_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).drop("class_key")


@query()
def op9_template_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


@query()
def op10_pfp_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

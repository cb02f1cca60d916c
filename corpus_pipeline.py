"""Training-data pipeline over `documents`: toxicity, exact copies, near copies, source mix, packing.

Each stage works on all that the one before kept. The tables between stages are Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_index, ngram_join, poisson_mix, queries, tier_packing, toxicity_chain
from eventloom.llm.common import Tables


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't flag as toxic."""
    chain = toxicity_chain.train(docs, queries.table(spark, sf_dir, "labels"), queries.CATEGORIES)
    return toxicity_chain.drop_toxic(docs, chain, "toxic")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_index.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a global random order."""
    return poisson_mix.mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return tier_packing.pack_tiers(docs, queries.tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup),
          ("poisson_mix", source_mix), ("tier_packing", packing)]

#: The first stage is a trained model, which SQL can't express; the rows are tested against the stages' own references.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the packed pieces."""
    docs = queries.table(spark, sf_dir, "documents")
    tables = Tables(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = tables.put(f"{i}-{name}", stage(spark, docs, sf_dir))
        if i:
            tables.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs

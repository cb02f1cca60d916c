"""The registered corpus queries, each over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import (exact_index, html_paths, langid, level_products, license_scan, line_edit, merkle_manifest, ngram_join, packed_ids, pivot_search, poisson_mix,
                           tier_packing, toxicity_chain)

TOKENIZER = "word_bpe_49k.json"
#: Toxicity categories in the order of the chain, as conditions on the label table.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_main(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).drop("row_key")


def op3_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.dedup_exact(table(spark, sf_dir, "documents")).drop("row_key")


def op4_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_line_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit.line_summary(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), langid.one_third())


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix_sources(table(spark, sf_dir, "documents"))


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.pack_rows(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack_tiers(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity_chain.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity_chain.score_toxicity(docs, chain).withColumnRenamed("is_toxic", "toxic").withColumn("kept", ~F.col("toxic"))


def op11_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_products.divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(table(spark, sf_dir, "documents"))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_paths, op2_ngram_join, op3_exact_index, op4_pivot_search, op5_line_edit, op6_langid,
                                   op7_poisson_mix, op8_packed_ids, op9_tier_packing, op10_toxicity_chain, op11_level_products, op12_merkle_manifest, op13_license_rules)}

ORACLE_SQL = {
    "op3_exact_index": """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from n window w as (partition by t)
""",
    "op4_pivot_search": pivot_search.TOP_K_SQL,
    "op7_poisson_mix": poisson_mix.MIX_SQL,
    "op11_level_products": level_products.DIVERGENCE_SQL,
    "op12_merkle_manifest": merkle_manifest.AUDIT_SQL,
}

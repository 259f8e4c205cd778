"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenarc.llm import blocks, decontaminate, forest, mixing, packing, quality, secrets, slots, spotsigs, sql, suffixes, toxicity, trie, vafile


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_documents(spark, sf_dir))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_documents(spark, sf_dir))


def op3_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first(_documents(spark, sf_dir))


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_neighbours(_documents(spark, sf_dir))


def op5_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard_documents(_documents(spark, sf_dir))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op11_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array, op2_lsh_forest, op3_line_first_quality, op4_spot_signatures, op5_block_tree, op6_best_fit_packing, op7_virtual_slots, op8_compression_toxicity, op9_secret_field, op10_source_mix, op11_va_file, op12_prefix_trie, op13_prefix_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_first_quality": sql.QUALITY, "op7_virtual_slots": sql.SLOTS, "op10_source_mix": sql.MIXING, "op11_va_file": sql.VECTORS, "op12_prefix_trie": sql.TRIE, "op13_prefix_filter": sql.BENCHMARK}

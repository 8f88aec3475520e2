"""The registered corpus queries, with the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import (
    cover_tree, fill_in_middle, label_sharding, line_frequency, metric_join, mixing, oracles, ordinal_quality, positional_index, pseudonyms, rank_profiles, spelling, suffix_dedup,
    token_codes,
)
from kinweave.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.similar_sets(documents(spark, folder), 3, 90).drop("root")


@query
def op2_positional_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = positional_index.contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op3_line_frequency_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.quality_rules(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


@query
def op4_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # needed by this query alone

    path = token_codes.shared_folder(spark, "token-codes")
    token_codes.write_tokens(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_codes.read_documents(spark, path)


@query
def op5_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = ordinal_quality.quality_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return ordinal_quality.grade_documents(docs, model, ["doc_id"])


@query
def op7_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, folder), key="corpus")


@query
def op8_label_shards(spark: SparkSession, folder: str) -> DataFrame:
    return label_sharding.shard_documents(documents(spark, folder))

@query
def op9_rank_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return rank_profiles.predict_languages(documents(spark, folder))

@query
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    changed, untouched = suffix_dedup.remove_repeats(documents(spark, folder))
    changed = changed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return changed.unionByName(untouched.withColumn("n_removed", F.lit(0).cast("bigint")))


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    moved = fill_in_middle.transform(documents(spark, folder))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(back, 256).alias("restored_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder), noise=97)


@query
def op13_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)

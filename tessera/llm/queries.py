"""The thin queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    html_text, lattice_dup, line_dedup, mixing, near_dup, packing, prefix_trie, quality_model, quality_rules,
    ranked_search, sql, toxicity, url_filter, warc,
)
from tessera.llm.common import crc_mod


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = crc_mod(F.col("doc_id"), 5) != 0
    found = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), usable)
    return found.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_read(spark, sf_dir, "documents"))


def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = quality_model.fit(docs, _read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return quality_model.scored(docs, weights, keep=["doc_id"], name="score").select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_read(spark, sf_dir, "documents"), near_dup.Banding(words=2, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_e8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs, kept="kept_spans").select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "kept_spans")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op13_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_vocabulary": url_filter.oracle(),
        "op6_minhash_near_dup": sql.NEAR_DUP,
        "op7_e8_near_vectors": sql.NEAR_VECTORS,
        "op8_pfair_mixing": sql.MIXING,
        "op11_ranked_search": ranked_search.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_warc_chain": warc.ORACLE,
    }

"""Corpus pipeline: documents in, packed token sequences out. Part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's result as
Parquet in the shared folder and rereads it as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dup, packing, quality_model
from tessera.llm.common import cut

#: SQL cannot express the trained classifier or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from a sample of at most about ``Ftrl.max_docs`` labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_model.fit(docs, labels, F.lit(True))
    return quality_model.accepted(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of lines and sentences; n_chars follows the text."""
    cleaned = line_dedup.without_repeats(docs, kept=None)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset; sequences are numbered in the order in which the documents are stored, so they come mixed."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), place=stored_place())


def stored_place() -> Column:
    """A row's place among the Parquet files that Spark wrote in order: the file's number, then the row's in it."""
    name = F.col("_metadata.file_name")
    file = F.coalesce(F.regexp_extract(name, r"^part-(\d+)-", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(file, 40) + F.col("_metadata.row_index")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Driver tables seen as the engine's tables. Expressions are shared by Spark and the SQL of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column and expression, in SQL that both engines read.
IMAGE = {
    "id": "doc_id",
    "source_id": "CAST(substr(source, 4) AS BIGINT)",
    "abs_path": "concat('/lib/', source, '/img', doc_id, '.png')",
    "filename": "concat('img', doc_id % 997, '.png')",
    "size": "n_chars",
    "modified_at": "(doc_id * 37) % 1009",
    "prompt_pos": "text",
    "prompt_neg": "''",
    "checkpoint": "concat('m', doc_id % 7)",
    "source_kind": "CASE WHEN doc_id % 2 = 0 THEN 'comfy' ELSE 'a1111' END",
    "seed": "doc_id % 13",
    "steps": "doc_id % 40",
    "group_key_l0": "source",
    "group_key_l1": "lang",
    "group_key_l2": "concat(lang, '-', n_chars % 5)",
    "group_key_l3": "substr(md5(text), 1, 16)",
    "hidden": "doc_id % 11 = 0",
    "diffusion_model": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('dm', doc_id % 5) END",
    "text_encoder": "concat('te', doc_id % 3)",
    "controlnet": "CASE WHEN doc_id % 6 = 0 THEN 'cn' ELSE '' END",
    "workflow_template_id": "CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 END",
    "workflow_key": "concat('w', doc_id % 17)",
    "meta_ok": "doc_id % 29 <> 0",
    "parser_version": "CASE WHEN doc_id % 23 = 0 THEN 'v1' ELSE 'v2' END",
}
#: Names of an image's LoRAs by id: none, one, two, or one twice with an unnamed one.
_NAMES = "CASE doc_id % 4 WHEN 0 THEN {a}{z} WHEN 1 THEN {a}'a'{z} WHEN 2 THEN {a}'b', 'a'{z} ELSE {a}'c', 'c', ''{z} END"
LORA_NAMES = _NAMES.format(a="[", z="]")
IMAGES_SQL = "images AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in IMAGE.items()) + f", {LORA_NAMES} AS lora_names FROM documents)"
SCORES_SQL = "scores AS (SELECT doc_id AS image_id, (quality * 60 + toxic * 15 + doc_id % 25) * 1.0::DOUBLE AS internal_score FROM labels)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images."""
    names = F.expr(_NAMES.format(a="array(", z=")")).cast("array<string>")
    loras = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(1.0).alias("strength"), F.lit(None).cast("double").alias("clip_strength")))
    docs = table(spark, sf_dir, "documents")
    return docs.select(*(F.expr(e).alias(c) for c, e in IMAGE.items()), loras.alias("loras"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores."""
    value = (F.col("quality") * 60 + F.col("toxic") * 15 + F.col("doc_id") % 25).cast("double")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), value.alias("internal_score"))


def recommendation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and lineitem as prompts with recipes: brand and type are the recipe, the name the prompt, twice the quantity the score."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("p_name").alias("prompt_pos"), F.lit("").alias("prompt_neg"),
        F.concat_ws("|", "p_brand", "p_type").alias("recipe_signature"), (F.col("l_quantity") * 2).alias("score"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as normalised vectors (bucket, id, vec); the label is the bucket."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("bucket"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def identity_rows(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Half of the documents as files with identity keys."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == parity)
    return docs.select(
        F.col("doc_id").alias("id"), F.concat_ws("|", "n_chars", F.md5("text")).alias("content_key"),
        F.concat_ws("|", "lang", "source", "n_chars").alias("meta_sig"), F.md5("text").alias("content_fp"),
        F.concat("lang", F.lit("-"), (F.col("n_chars") % 5).cast("string")).alias("group_key_l2"),
    )


IDENTITY_SQL = """files AS (SELECT doc_id AS id, doc_id % 2 AS side, concat(n_chars, '|', md5(text)) AS content_key,
  concat(lang, '|', source, '|', n_chars) AS meta_sig, md5(text) AS content_fp, concat(lang, '-', n_chars % 5) AS group_key_l2 FROM documents)"""

"""Queries of the parsers: rows of the driver tables are written as file contents and read back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import bindings as b
from tessera.plans.registry import register
from tessera.sources.metadata import PNG_MAGIC, parse_graph, parse_image, parse_parameters, png_chunk, rewrite_prompts



@register("f18_parse_parameters", """SELECT DISTINCT conv_id, turn, 20::BIGINT AS steps, 7.5::DOUBLE AS cfg, conv_id AS seed, 512::BIGINT AS width, 768::BIGINT AS height,
concat('m', turn) AS checkpoint FROM conversations""")
def f18(spark, sf_dir):
    rows = b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("a prompt\nNegative prompt: bad\nSteps: 20, Sampler: Euler a, CFG scale: 7.5, Seed: "), F.col("conv_id").cast("string"),
        F.lit(", Size: 512x768, Model: m"), F.col("turn").cast("string")).alias("p"),
    ).distinct()
    m = rows.select("conv_id", "turn", parse_parameters("p").alias("m"))
    s = F.col("m.samplers")[0]
    return m.select("conv_id", "turn", s["steps"].alias("steps"), s["cfg"].alias("cfg"), s["seed"].alias("seed"), "m.width", "m.height", "m.checkpoint")


def _graph(prompt: str, seed: int, model: str) -> str:
    return json.dumps({
        "1": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": model}},
        "2": {"class_type": "CLIPTextEncode", "inputs": {"text": prompt, "clip": ["1", 1]}},
        "3": {"class_type": "CLIPTextEncode", "inputs": {"text": "bad", "clip": ["1", 1]}},
        "4": {"class_type": "KSampler", "inputs": {"model": ["1", 0], "positive": ["2", 0], "negative": ["3", 0], "seed": seed, "steps": 20, "cfg": 7.0,
              "sampler_name": "euler", "scheduler": "normal"}},
    })


@F.pandas_udf(T.BinaryType())
def _png(prompts: pd.Series, seeds: pd.Series, models: pd.Series) -> pd.Series:
    head = PNG_MAGIC + png_chunk(b"IHDR", (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0")
    return pd.Series([
        head + png_chunk(b"tEXt", b"prompt\0" + _graph(p, int(s), m).encode()) + png_chunk(b"IDAT", b"x") + png_chunk(b"IEND", b"")
        for p, s, m in zip(prompts, seeds, models)
    ])


@register("s5_png_round_trip", """SELECT item_id, md5(text) AS prompt, 'bad' AS prompt_neg, item_id AS seed, concat('m', item_id % 3) AS checkpoint, 640::BIGINT AS width,
'CLIPTextEncode->KSampler' AS edge FROM benchmark WHERE text <> ''""")
def s5(spark, sf_dir):
    rows = b.table(spark, sf_dir, "benchmark").where("text <> ''")
    files = rows.select("item_id", _png("text", "item_id", F.concat(F.lit("m"), (F.col("item_id") % 3).cast("string"))).alias("content"))
    m = files.select("item_id", parse_image(F.lit("x.png"), "content").alias("m"))
    return m.select(
        "item_id", F.md5("m.prompt_pos").alias("prompt"), "m.prompt_neg", F.col("m.samplers")[0]["seed"].alias("seed"), "m.checkpoint", "m.width",
        F.col("m.e")[0].alias("edge"),
    )


@register("k14_rewrite_prompt", "SELECT item_id, concat('new ', item_id) AS prompt_pos, 'none' AS prompt_neg FROM benchmark WHERE text <> ''")
def k14(spark, sf_dir):
    rows = b.table(spark, sf_dir, "benchmark").where("text <> ''")
    files = rows.select("item_id", _png("text", "item_id", F.lit("m")).alias("content"), F.concat(F.lit("new "), F.col("item_id").cast("string")).alias("p"))
    edited = files.select("item_id", rewrite_prompts("content", "p", F.lit("none")).alias("content"))
    return edited.select("item_id", parse_image(F.lit("x.png"), "content").alias("m")).select("item_id", "m.prompt_pos", "m.prompt_neg")


@register("f19_parse_graph", "SELECT item_id, md5(text) AS prompt FROM benchmark WHERE text <> ''")
def f19(spark, sf_dir):
    rows = b.table(spark, sf_dir, "benchmark").where("text <> ''")
    graph = F.to_json(F.create_map(
        F.lit("1"), F.struct(F.lit("Text").alias("class_type"), F.struct(F.col("text").alias("text"), F.array(F.lit("9")).alias("positive")).alias("inputs")),
        F.lit("2"), F.struct(F.lit("KSampler").alias("class_type"), F.struct(F.lit("").alias("text"), F.array(F.lit("1")).alias("positive")).alias("inputs")),
    ))
    return rows.select("item_id", parse_graph(graph).alias("m")).select("item_id", F.md5("m.prompt_pos").alias("prompt"))

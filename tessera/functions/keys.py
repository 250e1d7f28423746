"""Group keys, identity keys and recipe signatures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import UNKNOWN
from tessera.functions.text import embedding_refs, normalize_prompt

SEPARATOR, LEVEL_MARK, VALUE_END, PROMPT_MARK = "\u0001", "\u0002", "\u001f", "\u0003"
L1_PREFIX = "model-deviation:v2"


@F.pandas_udf(T.StringType())
def xxh3_hex(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """XXH3-64 as 16 hex digits: the keys of existing libraries."""
    import xxhash

    for s in values:
        yield s.map(lambda v: None if v is None else xxhash.xxh3_64_hexdigest(v.encode()))


def hash16(value: Column, policy: str = "md5") -> Column:
    """16 hex digits of a string: the first of its md5, or its XXH3 for keys of existing libraries."""
    return xxh3_hex(value) if policy == "xxh3" else F.substring(F.md5(value), 1, 16)


def key_l0(source_path: Column, policy: str = "md5") -> Column:
    return hash16(source_path, policy)


def sorted_names(loras: Column) -> Column:
    """Distinct trimmed LoRA names, sorted; strengths do not count."""
    names = F.coalesce(F.transform(loras, lambda x: F.trim(x["name"])), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def dimension_values(dimension: str, columns: dict[str, Column]) -> Column:
    """Values of one of the six dimensions as an array; ``(unknown)`` where there is none."""

    def single(c: Column) -> Column:
        return F.when(F.trim(c) != "", F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))

    if dimension == "base_model":
        found = single(F.coalesce(F.nullif(F.trim(columns["diffusion_model"]), F.lit("")), columns["checkpoint"]))
    elif dimension == "lora":
        found = sorted_names(columns["loras"])
    elif dimension == "embedding":
        found = F.array_sort(F.array_distinct(columns["embeddings"])) if "embeddings" in columns else F.array_sort(embedding_refs(columns["prompt_pos"]))
    else:
        found = single(columns[dimension])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNKNOWN)))


def key_l1(dimension: str, values: Column, policy: str = "md5") -> Column:
    """Key of a row's values under one dimension."""
    body = F.aggregate(values, F.lit(""), lambda s, v: F.concat(s, v, F.lit(VALUE_END)))
    return hash16(F.concat(F.lit(L1_PREFIX + SEPARATOR + dimension + SEPARATOR), body), policy)


def key_l3(dimension: str, l1: Column, prompt: Column, policy: str = "md5") -> Column:
    """Key of an individual prompt within its L1 bucket."""
    head = F.lit(L1_PREFIX + SEPARATOR + dimension + SEPARATOR)
    return hash16(F.concat(head, l1, F.lit(PROMPT_MARK), normalize_prompt(F.coalesce(prompt, F.lit("")))), policy)


def prompt_hash(prompt: Column, policy: str = "md5") -> Column:
    return hash16(normalize_prompt(F.coalesce(prompt, F.lit(""))), policy)


def text_cluster_key(l1: Column, hashes: Column, policy: str = "md5") -> Column:
    """Key of a text cluster from its distinct prompt hashes; changes with the set of prompts."""
    return hash16(F.concat(l1, F.lit(LEVEL_MARK), F.concat_ws(LEVEL_MARK, F.array_sort(F.array_distinct(hashes)))), policy)


def vector_cluster_key(l1: Column, least_id: Column, policy: str = "md5") -> Column:
    """Key of a vector cluster from its smallest id; stable as the cluster grows."""
    return hash16(F.concat(F.lit("vec" + SEPARATOR), l1, F.lit(PROMPT_MARK), least_id.cast("string")), policy)


def manual_key(hashes: Column, policy: str = "md5") -> Column:
    return hash16(F.concat(F.lit("manual:"), F.concat_ws("", F.array_sort(F.array_distinct(hashes)))), policy)


def dimension_label(values: Column) -> Column:
    """``a + b (×n)`` for several values, the value itself for one."""
    n = F.size(values)
    joined = F.concat_ws(" + ", values)
    return F.when(n > 1, F.concat(joined, F.lit(" (×"), n.cast("string"), F.lit(")"))).otherwise(joined)


def content_key(size: Column, seed: Column, positive: Column, negative: Column) -> Column:
    """Exact identity of a file's content, not hashed; prompts are prefixed with their lengths."""
    p, n = F.coalesce(positive, F.lit("")), F.coalesce(negative, F.lit(""))
    zero = F.lit(0).cast("bigint")
    return F.concat_ws(
        "|", F.coalesce(size, zero).cast("string"), F.coalesce(seed, zero).cast("string"), F.char_length(p).cast("string"), p, F.char_length(n).cast("string"), n
    )


def metadata_signature(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width / height).otherwise(0.0)


def recipe_signature(recipe: Column, policy: str = "md5") -> Column:
    """Hash of a normalised recipe."""
    return hash16(F.to_json(recipe), policy)


def normalized_recipe(recipe: Column) -> Column:
    """Names trimmed, LoRAs without a name dropped and sorted by name and strengths."""
    loras = F.array_sort(
        F.filter(
            F.transform(
                F.coalesce(recipe["loras"], F.array().cast("array<struct<name:string,strength:double,clip_strength:double>>")),
                lambda x: F.struct(F.trim(x["name"]).alias("name"), x["strength"].alias("strength"), x["clip_strength"].alias("clip_strength")),
            ),
            lambda x: x["name"] != "",
        )
    )
    out = recipe.withField("loras", loras)
    for name in ("checkpoint", "diffusion_model", "vae", "sampler", "scheduler"):
        out = out.withField(name, F.trim(F.coalesce(recipe[name], F.lit(""))))
    return out


def complete_recipe(recipe: Column) -> Column:
    """Whether a recipe can be run again: a model, sampler and scheduler, steps, a finite cfg and a size."""
    model = (F.coalesce(recipe["checkpoint"], F.lit("")) != "") | (F.coalesce(recipe["diffusion_model"], F.lit("")) != "")
    finite = recipe["cfg"].isNotNull() & ~F.isnan(recipe["cfg"]) & (F.abs(recipe["cfg"]) < float("inf"))
    named = (recipe["sampler"] != "") & (recipe["scheduler"] != "")
    return F.coalesce(model & named & (recipe["steps"] > 0) & finite & (recipe["width"] > 0) & (recipe["height"] > 0), F.lit(False))

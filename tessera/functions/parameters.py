"""Parameter texts as columns: prompt, negative prompt and the line of settings, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}++|(?<!{_SPACE}){_SPACE}++\z", "")


def whole_number(text: Column) -> Column:
    """A whole number, or 0 where the text is none or no bigint holds it."""
    t = trimmed(text)
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")), F.lit(0).cast("bigint"))


def real_number(text: Column) -> Column:
    """A decimal number, or 0.0 where the text is none."""
    t = trimmed(text)
    return F.coalesce(F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double")), F.lit(0.0))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _names(value: Column) -> Column:
    """Names before the colons of a quoted list ``"a: 1, b: 2"``."""
    bare = F.regexp_replace(value, r'\A"++|(?<!")"++\z', "")
    return F.filter(F.transform(F.split(bare, ","), lambda p: trimmed(F.substring_index(p, ":", 1))), lambda n: n != "")


def _pair(part: Column) -> Column:
    at = F.instr(part, ": ")
    return F.struct(trimmed(part.substr(F.lit(1), at - 1)).alias("k"), trimmed(part.substr(at + 2, F.length(part))).alias("v"))


def _cut(text: Column) -> tuple[Column, Column, Column]:
    """What stands before the settings, their line, and whether there is one."""
    t = F.coalesce(text, F.lit(""))
    first, at = F.startswith(t, F.lit("Steps:")), F.instr(t, "\nSteps:")
    head = F.when(first, F.lit("")).when(at > 0, t.substr(F.lit(1), at - 1)).otherwise(t)
    line = F.when(first, F.substring_index(t, "\n", 1)).when(at > 0, F.substring_index(t.substr(at + 1, F.length(t)), "\n", 1)).otherwise(F.lit(""))
    return head, line, (at > 0) | first


def _sides(head: Column) -> Column:
    return F.split(head, r"(?md)^[ \t]*+Negative prompt:[ \t]*+", 2)


def prompts(text: Column) -> Column:
    """(positive, negative) of a parameter text alone."""
    return bound(_sides(_cut(text)[0]), lambda p: F.struct(trimmed(F.get(p, 0)).alias("positive"), trimmed(F.coalesce(F.get(p, 1), F.lit(""))).alias("negative")))


def parameters_struct(text: Column) -> Column:
    """The metadata struct of a parameter text: what stands before ``Negative prompt:``, after it, and the settings.

    The settings are the line that starts with ``Steps:``, split on ``, ``; of a
    key given twice the last value counts. Null and texts without settings are
    all prompt; a number that is none is 0.
    """
    head, line, has = _cut(text)
    pairs = F.transform(F.filter(F.split(line, ", "), lambda p: F.contains(p, F.lit(": "))), _pair)
    parts = F.struct(_sides(head).alias("prompts"), pairs.alias("pairs"), has.alias("set"))
    return bound(parts, _meta)


def _meta(r: Column) -> Column:
    found = lambda key: F.get(F.reverse(F.filter(r["pairs"], lambda p: p["k"] == key)), 0)["v"]
    said = lambda key: F.coalesce(found(key), F.lit(""))
    size = lambda key, part: F.coalesce(F.nullif(whole_number(found(key)), F.lit(0)), whole_number(F.get(F.split(said("Size"), "x", 2), part)))
    empty = F.lit("")
    loras = F.transform(_names(said("Lora hashes")), lambda n: F.struct(n.alias("name"), F.lit(1.0).alias("strength"), F.lit(None).cast("double").alias("clip_strength")))
    sampler = F.struct(
        said("Sampler").alias("sampler"), whole_number(found("Seed")).alias("seed"), whole_number(found("Steps")).alias("steps"),
        real_number(found("CFG scale")).alias("cfg"), F.coalesce(found("Scheduler"), found("Schedule type"), empty).alias("scheduler"),
    )
    none = F.array().cast("array<string>")
    return F.struct(
        trimmed(F.get(r["prompts"], 0)).alias("prompt_pos"), trimmed(F.coalesce(F.get(r["prompts"], 1), empty)).alias("prompt_neg"), said("Model").alias("checkpoint"),
        empty.alias("diffusion_model"), said("VAE").alias("vae"), empty.alias("text_encoder"), empty.alias("controlnet"), loras.alias("loras"),
        F.when(r["set"], F.array(sampler)).otherwise(F.array().cast("array<struct<sampler: string, seed: bigint, steps: bigint, cfg: double, scheduler: string>>")).alias("samplers"),
        F.array().cast("array<struct<node_type: string, model: string, strength: double, enabled: boolean>>").alias("model_chain"),
        F.array_distinct(_names(said("TI hashes"))).alias("embeddings"), none.alias("t"), none.alias("e"), size("Width", 0).alias("width"),
        size("Height", 1).alias("height"), F.lit("a1111").alias("source_kind"), F.lit(True).alias("meta_ok"),
    )

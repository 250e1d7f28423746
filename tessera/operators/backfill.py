"""Backfills of older libraries: one spelling of paths, merged sources and images, keys and recipes made anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.keys import complete_recipe, key_l0, normalized_recipe, recipe_signature
from tessera.functions.text import normalize_path
from tessera.store import table_of

#: Tables with rows about an image: their image column and the columns that must stay unique with it.
DEPENDENT = {
    "scores": ("image_id", []), "image_labels": ("image_id", ["label_id"]), "manual_group_bindings": ("image_id", ["level"]), "image_signatures": ("image_id", ["slot"]),
}
BACKFILLED = "legacy-backfill-v1"


def remapped(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where the mapping (old, new) names its value."""
    return rows.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def same_by(rows: DataFrame, key: Column) -> DataFrame:
    """(old, new): ids of rows with an equal key, and the least of them; rows that keep their id are left out."""
    keyed = rows.select("id", key.alias("_key"))
    least = keyed.groupBy("_key").agg(F.min("id").alias("new"), F.max("id").alias("_most")).where("new < _most").drop("_most")
    return keyed.join(least, "_key").where("id <> new").select(F.col("id").alias("old"), "new")


def one_each(rows: DataFrame, image: str, others: list[str], was: str) -> DataFrame:
    """One row per image and other key columns: that of the image's own old id first, then of the least."""
    order = W.partitionBy(image, *others).orderBy(F.col(was).eqNullSafe(F.col(image)).desc(), F.asc(was), *([F.asc("group_key")] if "group_key" in rows.columns else []))
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def normalized_library(tables: dict[str, DataFrame], policy: str = "md5") -> dict[str, DataFrame]:
    """The library with one spelling per path.

    Sources whose paths normalise to one are one source (the least id), and so
    are images; what hangs on an image goes to the one that stays, whose own rows
    win where two clash. Folder keys (level 0) are made from the paths, in images
    and in bindings that name them. Running it again changes nothing.
    """
    sources, images = tables["sources"], tables["images"]
    moved = table_of(same_by(sources, normalize_path(F.col("path"))))
    kept = sources.withColumn("path", normalize_path(F.col("path"))).join(moved.select(F.col("old").alias("id")), "id", "left_anti")
    kept = table_of(kept)
    placed = remapped(images, moved, "source_id").withColumn("abs_path", normalize_path(F.col("abs_path")))
    twins = table_of(same_by(placed, F.struct("source_id", "abs_path")))
    folder = kept.select(F.col("id").alias("source_id"), key_l0(F.col("path"), policy).alias("_l0"))
    before = placed.select(F.col("group_key_l0").alias("old"), "source_id").distinct()
    placed = placed.join(twins.select(F.col("old").alias("id")), "id", "left_anti").join(folder, "source_id", "left")
    out = dict(tables) | {"sources": kept, "images": placed.withColumn("group_key_l0", F.coalesce("_l0", "group_key_l0")).drop("_l0").select(*images.columns)}
    keys = before.join(folder, "source_id").where("old <> _l0").groupBy("old").agg(F.min("_l0").alias("new"))
    for name, (image, others) in DEPENDENT.items():
        if name not in tables:
            continue
        rows = remapped(tables[name].withColumn("_was", F.col(image)), twins, image)
        rows = one_each(rows, image, others, "_was").drop("_was")
        if name == "manual_group_bindings":
            folders = remapped(rows.where("level = 0"), keys, "group_key")
            rows = rows.where("level <> 0").unionByName(folders)
        out[name] = rows.select(*tables[name].columns)
    return out


def backfilled_recipes(images: DataFrame, policy: str = "md5") -> DataFrame:
    """Images without a recipe get one from their columns, with its signature; others stay as they are."""
    s = F.get("samplers", 0)
    recipe = F.struct(
        F.coalesce("checkpoint", F.lit("")).alias("checkpoint"), F.coalesce("diffusion_model", F.lit("")).alias("diffusion_model"), "loras", F.coalesce("vae", F.lit("")).alias("vae"),
        F.coalesce(s["sampler"], F.lit("")).alias("sampler"), F.coalesce(s["scheduler"], F.lit("")).alias("scheduler"), F.coalesce(s["steps"], F.lit(0)).alias("steps"),
        F.coalesce(s["cfg"], F.lit(0.0)).alias("cfg"), F.greatest(F.coalesce("width", F.lit(0)), F.lit(0)).alias("width"), F.greatest(F.coalesce("height", F.lit(0)), F.lit(0)).alias("height"),
        F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height")).otherwise(0.0).alias("aspect_ratio"),
    )
    lacks = F.col("recipe").isNull()
    full = images.withColumn("_recipe", normalized_recipe(recipe))
    signature = F.when(complete_recipe(F.col("_recipe")), recipe_signature(F.col("_recipe"), policy))
    return full.select(*(
        F.when(lacks, F.col("_recipe")).otherwise(F.col(c)).alias(c) if c == "recipe"
        else F.when(lacks, signature).otherwise(F.col(c)).alias(c) if c == "recipe_signature"
        else F.when(lacks, F.lit(BACKFILLED)).otherwise(F.col(c)).alias(c) if c == "parser_version" else F.col(c) for c in images.columns
    ))


def backfilled_models(images: DataFrame) -> DataFrame:
    """Empty text_encoder and controlnet columns from the first such node of the model chain."""
    def first(pattern: str) -> Column:
        return F.get(F.filter("model_chain", lambda m: m["node_type"].rlike(pattern) & (F.coalesce(m["model"], F.lit("")) != "")), 0)["model"]

    bare = lambda c: F.coalesce(c, F.lit("")) == ""
    encoder = F.when(bare(F.col("text_encoder")), F.coalesce(first("(?i)cliploader"), F.col("text_encoder"))).otherwise(F.col("text_encoder"))
    net = F.when(bare(F.col("controlnet")), F.coalesce(first("(?i)controlnet"), F.col("controlnet"))).otherwise(F.col("controlnet"))
    return images.withColumn("text_encoder", encoder).withColumn("controlnet", net)

"""Group listings, facets, members, thumbnails, coverage and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.constants import BASE_SCORE, UNKNOWN, level_column
from tessera.functions.keys import dimension_values, key_l1, key_l3

#: Columns a group shows by their least value.
SHOWN = ("prompt_pos", "checkpoint", "source_kind", "abs_path", "diffusion_model", "text_encoder", "controlnet")


def visible(images: DataFrame, source_id: int | None = None, include_hidden: bool = False) -> DataFrame:
    """Images that are not hidden, of one source where one is given."""
    rows = images if include_hidden else images.where(~F.coalesce(F.col("hidden"), F.lit(False)))
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)


def list_groups(images: DataFrame, level: int, source_id: int | None = None) -> DataFrame:
    """Groups of a level with their count and least shown values; largest first, then by key."""
    key = level_column(level)
    rows = visible(images, source_id).where(F.col(key).isNotNull())
    shown = [F.min(c).alias(c) for c in SHOWN if c in images.columns]
    return (
        rows.groupBy(F.col(key).alias("group_key")).agg(F.count("*").alias("count"), *shown)
        .orderBy(F.desc("count"), F.asc("group_key"))
    )


def with_template_names(groups: DataFrame, images: DataFrame, templates: DataFrame, level: int, source_id: int | None = None) -> DataFrame:
    """Listed groups with the least name of their visible images' templates, null for a group without any."""
    named = templates.select(F.col("id").alias("workflow_template_id"), "name")
    rows = visible(images, source_id).where("workflow_template_id is not null").join(named, "workflow_template_id")
    least = rows.groupBy(F.col(level_column(level)).alias("group_key")).agg(F.min("name").alias("template_name"))
    return groups.join(least, "group_key", "left").orderBy(F.desc("count"), F.asc("group_key"))


def diagnostics_by(images: DataFrame, level: int) -> DataFrame:
    """Per group of a level: its different checkpoints and kinds as comma-joined lists, how many are hidden, how many were parsed badly."""
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c))).alias(f"{c}s")
    bad = F.count_if(~F.coalesce(F.col("meta_ok"), F.lit(False))).alias("failed")
    return images.groupBy(F.col(level_column(level)).alias("group_key")).agg(joined("checkpoint"), joined("source_kind"), F.count_if(F.coalesce(F.col("hidden"), F.lit(False))).alias("hidden"), bad)


def signatures_for(signatures: DataFrame, slot: str, model: str, images: DataFrame | None = None, source_id: int | None = None) -> DataFrame:
    """(image_id, vec) of a slot and model, of one source's images where one is given; vectors of another length than their ``dim`` are left out."""
    rows = signatures.where((F.col("slot") == slot) & (F.col("model_id") == model) & F.col("vec").isNotNull() & (F.size("vec") == F.col("dim")))
    if images is not None and source_id is not None:
        rows = rows.join(images.where(F.col("source_id") == source_id).select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return rows.select("image_id", "vec")


def probes(images: DataFrame, scores: DataFrame, bindings: DataFrame, image_labels: DataFrame) -> DataFrame:
    """(id, has_score, has_binding, has_label) of all images at once, by semi-joined ids."""
    def has(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("image_id").alias("id")).distinct().withColumn(name, F.lit(True))

    found = images.select("id")
    for rows, name in ((scores, "has_score"), (bindings, "has_binding"), (image_labels, "has_label")):
        found = found.join(has(rows, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return found


def move_targets(images: DataFrame, current: str, source_id: int | None = None) -> DataFrame:
    """Level-2 groups other than the current one."""
    return list_groups(images, 2, source_id).where(F.col("group_key") != current)


def has_lora(name: str) -> Column:
    """Whether the image's LoRAs have this name; a null list has none."""
    return F.coalesce(F.exists("loras", lambda x: x["name"] == name), F.lit(False))


def without_lora() -> Column:
    return ~F.coalesce(F.exists("loras", lambda x: F.coalesce(x["name"], F.lit("")) != ""), F.lit(False))


def lora_groups(images: DataFrame, source_id: int | None = None) -> DataFrame:
    """Images per LoRA name, each image once per name; images without a named LoRA are ``(unknown)``."""
    names = F.array_distinct(F.filter(F.transform("loras", lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != ""))
    name = F.explode_outer(names).alias("name")
    return (
        visible(images, source_id).select("id", name)
        .groupBy(F.concat(F.lit("lora-single:"), F.coalesce("name", F.lit(UNKNOWN))).alias("group_key"))
        .agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("group_key"))
    )


def model_facets(images: DataFrame) -> DataFrame:
    """Models within each L1 group with their counts, as one row per group."""
    model = F.coalesce(F.nullif(F.col("diffusion_model"), F.lit("")), F.lit("(未知)")).alias("model")
    counted = visible(images).where(F.col("group_key_l1").isNotNull()).groupBy("group_key_l1", model).agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "model", "n")))
    return counted.groupBy("group_key_l1").agg(ordered.alias("f")).select(
        "group_key_l1", F.transform("f", lambda x: F.struct(x["model"].alias("model"), x["n"].alias("count"))).alias("facets")
    )


def facet_counts(images: DataFrame) -> DataFrame:
    """The facets as rows (group_key_l1, model, count)."""
    return model_facets(images).select("group_key_l1", F.explode("facets").alias("f")).select("group_key_l1", "f.model", "f.count")


def group_members(images: DataFrame, level: int = 2) -> DataFrame:
    """Group, count, least prompt and sorted member ids."""
    key = level_column(level)
    return visible(images, include_hidden=True).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("group_key")).agg(
        F.count("*").alias("count"), F.min("prompt_pos").alias("prompt_pos"), F.array_sort(F.collect_list("id")).alias("members")
    )


def thumbnails(images: DataFrame, level: int, n: int = 4, keys: list[str] | None = None) -> DataFrame:
    """First paths of each group by (seed, filename)."""
    key = level_column(level)
    rows = visible(images).where(F.col(key).isNotNull())
    if keys is not None:
        rows = rows.where(F.col(key).isin(keys))
    order = W.partitionBy(key).orderBy(F.asc_nulls_first("seed"), F.asc_nulls_first("filename"), F.asc("id"))
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "abs_path")))
    return top.groupBy(F.col(key).alias("group_key")).agg(F.transform(listed, lambda x: x["abs_path"]).alias("paths"))


def members(images: DataFrame, level: int, key: str, source_id: int | None = None) -> DataFrame:
    """A group's images in browse order, hidden ones included."""
    return visible(images, source_id, include_hidden=True).where(F.col(level_column(level)) == key).orderBy(
        F.asc_nulls_first("seed"), F.asc_nulls_first("filename"), "id"
    )


def ids_for_keys(images: DataFrame, level: int, keys: list[str], source_id: int | None = None) -> DataFrame:
    return visible(images, source_id, include_hidden=True).where(F.col(level_column(level)).isin(keys)).select("id").orderBy("id")


def with_scores(images: DataFrame, scores: DataFrame) -> DataFrame:
    """Images with ``score``, the base score where there is none, and ``scored``."""
    s = scores.select(F.col("image_id").alias("_s"), F.col("internal_score").alias("_v"))
    return images.join(s, F.col("id") == F.col("_s"), "left").withColumn("score", F.coalesce("_v", F.lit(BASE_SCORE))).withColumn(
        "scored", F.col("_v").isNotNull()
    ).drop("_s", "_v")


def label_lists(image_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, labels): each image's label names in the order of label ids."""
    pairs = image_labels.join(labels.select(F.col("id").alias("label_id"), "name"), "label_id")
    listed = F.array_sort(F.collect_set(F.struct("label_id", "name")))
    return pairs.groupBy("image_id").agg(F.transform(listed, lambda x: x["name"]).alias("labels"))


def image_rows(images: DataFrame, sources: DataFrame, templates: DataFrame, bindings: DataFrame, scores: DataFrame, image_labels: DataFrame, labels: DataFrame) -> DataFrame:
    """Images joined with source path, template name, level-2 binding, score and labels: one plan, no query per row."""
    manual = bindings.where(F.col("level") == 2).select(F.col("image_id").alias("_b"), F.col("kind").alias("binding_kind"))
    named = label_lists(image_labels, labels).withColumnRenamed("image_id", "_l")
    return (
        with_scores(images, scores)
        .join(sources.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id")
        .join(templates.select(F.col("id").alias("workflow_template_id"), F.col("name").alias("template_name")), "workflow_template_id", "left")
        .join(manual, F.col("id") == F.col("_b"), "left").join(named, F.col("id") == F.col("_l"), "left").drop("_b", "_l")
        .withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    )


def manual_groups(images: DataFrame, bindings: DataFrame) -> DataFrame:
    """Level-2 groups that any binding has touched."""
    touched = bindings.where(F.col("level") == 2).select(F.col("image_id").alias("id"))
    return images.join(touched, "id", "left_semi").select(F.col("group_key_l2").alias("group_key")).distinct()


def coverage(images: DataFrame, signatures: DataFrame, slot: str, model_id: str, source_id: int | None = None) -> DataFrame:
    """(total, computed) of a slot. The text slot counts images with a prompt, the vision slot all images."""
    rows = visible(images, source_id, include_hidden=True)
    total = rows.where(F.col("prompt_pos") != "") if slot == "text" else rows
    done = signatures.where((F.col("slot") == slot) & (F.col("model_id") == model_id)).select(F.col("image_id").alias("id"))
    a = total.agg(F.count("*").alias("total"))
    b = rows.join(done, "id", "left_semi").agg(F.count("*").alias("computed"))
    return a.join(b)


def source_stats(images: DataFrame) -> DataFrame:
    return images.groupBy("source_id").agg(F.count("*").alias("file_count"), F.max("modified_at").alias("newest_mtime"))


def unmatched_workflows(images: DataFrame) -> DataFrame:
    """Workflow keys without a template, each with one graph of its images (the least as JSON)."""
    rows = images.where(F.col("workflow_template_id").isNull() & (F.coalesce("workflow_key", F.lit("")) != ""))
    return rows.groupBy("workflow_key").agg(F.min_by("workflow_graph", F.to_json("workflow_graph")).alias("workflow_graph"))


def needs_reparse(version: str) -> Column:
    """Rows whose metadata failed, or that another parser version wrote."""
    return ~F.coalesce(F.col("meta_ok"), F.lit(False)) | (F.coalesce("workflow_key", F.lit("")) == "") | ~F.col("parser_version").eqNullSafe(F.lit(version))


def can_move(images: DataFrame, picked: DataFrame, target: str) -> DataFrame:
    """Of each selection (selection, id): whether its images share a source, none is in the target, and the target exists."""
    own = picked.join(images.select("id", "source_id", "group_key_l2"), "id").groupBy("selection").agg(
        (F.countDistinct("source_id") == 1).alias("one_source"),
        (F.count_if(F.col("group_key_l2").eqNullSafe(F.lit(target))) == 0).alias("none_inside"),
    )
    there = images.agg(F.coalesce(F.bool_or(F.col("group_key_l2") == target), F.lit(False)).alias("target_exists"))  # one row
    return own.join(F.broadcast(there))


def file_missing(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Images with ``file_missing``: whether the listing (path) lacks them."""
    there = listing.select(F.col("path").alias("_p")).distinct()
    return images.join(there, F.col("abs_path") == F.col("_p"), "left").withColumn("file_missing", F.col("_p").isNull()).drop("_p")


def disk_status(images: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, status): matched, new or missing, by normalised path (columns ``norm_path``)."""
    a = images.select(F.col("norm_path").alias("stored")).distinct()
    b = listing.select(F.col("norm_path").alias("found")).distinct()
    return a.join(b, F.col("stored") == F.col("found"), "full_outer").select(
        F.coalesce("stored", "found").alias("path"),
        F.when(F.col("found").isNull(), "missing").when(F.col("stored").isNull(), "new").otherwise("matched").alias("status"),
    )


def rehash(images: DataFrame, dimension: str, source_id: int | None = None, policy: str = "md5") -> DataFrame:
    """(id, group_key_l1, group_key_l2, group_key_l3) of a source's images under another dimension.

    Level 2 starts from the new level 1 again; a recluster sets it.
    """
    rows = images if source_id is None else images.where(F.col("source_id") == source_id)
    values = dimension_values(dimension, {c: F.col(c) for c in rows.columns})
    l1 = rows.withColumn("_l1", key_l1(dimension, values, policy))
    return l1.select("id", F.col("_l1").alias("group_key_l1"), F.col("_l1").alias("group_key_l2"), key_l3(dimension, F.col("_l1"), F.col("prompt_pos"), policy).alias("group_key_l3"))

"""Incremental ingest of image folders into a library: one pass, or polled by durable streams."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import POLL_SECONDS, STABILITY_SECONDS, TEMPLATE_DEPTH, TEMPLATE_SECONDS
from tessera.functions.keys import (
    complete_recipe, content_key, dimension_values, key_l0, key_l1, key_l3, metadata_signature, normalized_recipe, recipe_signature,
)
from tessera.operators.blocks import numbered
from tessera.operators.clustering import recluster
from tessera.operators.graphs import assign_templates, contained
from tessera.operators.groups import needs_reparse
from tessera.operators.identity import informative, match_files
from tessera.schemas import CASCADE
from tessera.sources import files
from tessera.sources.files import templates_of
from tessera.sources.folder_source import folder_changes
from tessera.store import Store, table_of

PARSER_VERSION = "tessera-1"


@dataclass
class Synced:
    """What a pass has done."""

    new: int
    renamed: int
    removed: int
    pending: int
    again: int = 0


@F.pandas_udf(T.StringType())
def fingerprint(contents: pd.Series) -> pd.Series:
    """XXH3-64 of file contents as hex."""
    import xxhash

    return contents.map(lambda c: None if c is None else xxhash.xxh3_64_hexdigest(c))


def image_columns(parsed: DataFrame, source_id: int, source_path: str, dimension: str, policy: str = "md5") -> DataFrame:
    """Rows of the images table, but for their ids, from parsed files: with recipe, identity and group keys."""
    s, m = F.get("meta.samplers", 0), F.col("meta")
    recipe = F.struct(
        m["checkpoint"].alias("checkpoint"), m["diffusion_model"].alias("diffusion_model"), m["loras"].alias("loras"), m["vae"].alias("vae"),
        F.coalesce(s["sampler"], F.lit("")).alias("sampler"), F.coalesce(s["scheduler"], F.lit("")).alias("scheduler"), F.coalesce(s["steps"], F.lit(0)).alias("steps"),
        F.coalesce(s["cfg"], F.lit(0.0)).alias("cfg"), m["width"].alias("width"), m["height"].alias("height"),
        F.when((m["width"] > 0) & (m["height"] > 0), m["width"] / m["height"]).otherwise(0.0).alias("aspect_ratio"),
    )
    graph = F.to_json(F.struct(m["t"].alias("t"), m["e"].alias("e")))
    rows = parsed.withColumn("recipe", normalized_recipe(recipe)).select(
        F.lit(source_id).cast("bigint").alias("source_id"), F.col("norm_path").alias("abs_path"), F.regexp_extract("norm_path", r"([^/]*)$", 1).alias("filename"),
        F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_at"), *(m[c].alias(c) for c in (
            "width", "height", "prompt_pos", "prompt_neg", "checkpoint", "loras", "vae", "samplers", "diffusion_model", "text_encoder", "controlnet",
            "model_chain", "embeddings", "meta_ok", "source_kind")),
        F.coalesce(s["seed"], F.lit(0)).alias("seed"), F.coalesce(s["steps"], F.lit(0)).alias("steps"), F.coalesce(s["cfg"], F.lit(0.0)).alias("cfg"),
        F.struct(m["t"].alias("t"), m["e"].alias("e")).alias("workflow_graph"), F.when(F.size(m["t"]) > 0, F.substring(F.md5(graph), 1, 16)).otherwise("").alias("workflow_key"),
        "recipe", F.when(complete_recipe(F.col("recipe")), recipe_signature(F.col("recipe"), policy)).alias("recipe_signature"),
        F.lit(PARSER_VERSION).alias("parser_version"), F.lit(False).alias("hidden"), "content_fp",
    )
    l1 = key_l1(dimension, dimension_values(dimension, {c: F.col(c) for c in rows.columns}), policy)
    keyed = rows.withColumn("group_key_l0", key_l0(F.lit(source_path), policy)).withColumn("group_key_l1", l1)
    return keyed.withColumn("group_key_l2", F.col("group_key_l1")).withColumn("group_key_l3", key_l3(dimension, F.col("group_key_l1"), F.col("prompt_pos"), policy))


def identity_keys(images: DataFrame) -> DataFrame:
    """(id, content_key, meta_sig, content_fp) of images; a signature that says nothing is empty."""
    sig = metadata_signature(*(F.col(c) for c in ("workflow_key", "width", "height", "steps", "cfg", "recipe_signature")))
    return images.select(
        "id", content_key(F.col("size"), F.col("seed"), F.col("prompt_pos"), F.col("prompt_neg")).alias("content_key"),
        F.when(informative(F.col("workflow_key"), F.col("steps")), sig).otherwise("").alias("meta_sig"), "content_fp",
    )


def to_read(ready: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files (norm_path) to parse: unknown or changed ones, those whose last parse failed or is outdated, and those without a fingerprint."""
    stale = needs_reparse(PARSER_VERSION) | (F.coalesce("content_fp", F.lit("")) == "")
    current = known.where(~stale).select(F.col("abs_path").alias("norm_path"), F.col("size").alias("length"), F.col("modified_at").alias("_at"))
    return ready.withColumn("_at", F.unix_seconds("modificationTime")).join(current, ["norm_path", "length", "_at"], "left_anti").drop("_at")


@dataclass
class Plan:
    """What a pass does to a source's images: rows to update, moved ones, new ones, and those that go."""

    again: DataFrame
    moves: DataFrame
    inserts: DataFrame
    removed: DataFrame


def planned(known: DataFrame, listed: DataFrame, read: DataFrame, fresh: Callable[[DataFrame], DataFrame], keys: Callable[[DataFrame], DataFrame]) -> Plan:
    """Settle what has been ``read`` (abs_path, content_fp, ...) against the ``known`` rows and the ``listed`` paths.

    A known path with the same content is the same image. An image whose path is
    gone, or has other content now, moves to the one new content that its
    identity keys match; ``fresh`` gives new contents ids of their own first, so
    a new file at an old path never takes the old image's id. What has other
    content and moved nowhere was edited in place and keeps its id.
    """
    before = known.select("abs_path", *(F.col(c).alias(n) for c, n in (("id", "_id"), ("group_key_l1", "_l1"), ("group_key_l3", "_l3"), ("content_fp", "_fp"))))
    met = table_of(read.join(before, "abs_path", "left"))
    same = F.col("_id").isNotNull() & ((F.coalesce("_fp", F.lit("")) == "") | F.col("_fp").eqNullSafe(F.col("content_fp")))
    new = table_of(fresh(met.where(~same)))
    gone = known.join(listed.select(F.col("norm_path").alias("abs_path")), "abs_path", "left_anti").unionByName(
        known.join(new.where("_id is not null").select(F.col("_id").alias("id")), "id", "left_semi")
    )
    gone = table_of(gone)
    renamed = table_of(match_files(keys(gone), keys(new)).select("old_id", "new_id"))
    moves = new.join(renamed.withColumnRenamed("new_id", "id"), "id").select(F.col("old_id").alias("id"), "abs_path", "filename", "modified_at")
    rest = new.join(renamed.select(F.col("new_id").alias("id")), "id", "left_anti").join(renamed.select(F.col("old_id").alias("_id"), F.lit(True).alias("_left")), "_id", "left")
    edited = F.col("_id").isNotNull() & F.col("_left").isNull()
    again = table_of(met.where(same).withColumn("id", F.col("_id")).unionByName(rest.where(edited).drop("_left").withColumn("id", F.col("_id"))))
    inserts = table_of(rest.where(~edited).drop("_id", "_l1", "_l3", "_fp", "_left"))
    stay = renamed.select(F.col("old_id").alias("id")).union(again.select("id"))
    return Plan(again, table_of(moves), inserts, table_of(gone.join(stay, "id", "left_anti").select("id", "group_key_l1")))


#: Where ids of images stand, besides the images themselves.
_NAMED_IN = {**CASCADE, "archive_log": "image_id", "compare_pairs": "left_img, right_img", "review_actions": "image_id, left_image_id, right_image_id"}


def fresh_ids(store: Store, rows: DataFrame) -> DataFrame:
    """``rows`` (abs_path, ...) with an ``id`` that no image has, nor any row about one that is gone: the next ones, by path."""
    named = {"images": "id"} | _NAMED_IN
    used = [store.read(t).select(F.explode(F.array(*named[t].split(", "))).alias("id")) for t in named if store.has(t)]
    top = reduce(DataFrame.union, used).agg(F.max("id")).first()[0] or 0 if used else 0
    return numbered(rows, [F.asc("abs_path")], "_n").withColumn("id", F.col("_n") + F.lit(top)).drop("_n")


def with_contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The contents of the wanted files; others are opened only if as old and as large as some of those."""
    span = wanted.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("modificationTime", "length") for f in (F.min, F.max))).first()
    if span["min_length"] is None:
        return wanted.withColumn("content", F.lit(None).cast("binary"))
    only = F.col("modificationTime").between(span["min_modificationTime"], span["max_modificationTime"]) & F.col("length").between(span["min_length"], span["max_length"])
    opened = files.binary_files(spark, root, with_content=True, only=only).withColumn("norm_path", files.same_path(F.col("path")))
    return opened.join(wanted.select("norm_path"), "norm_path", "left_semi")


def sync_source(store: Store, source_id: int, root: str, dimension: str = "base_model", wait: bool | float = True, listing: DataFrame | None = None) -> Synced:
    """One pass over ``root``, or over a ``listing`` of it (path, modificationTime, length) made elsewhere.

    New and changed files are parsed, failed or outdated ones again; renamed ones
    keep their row, rows without a file go. Touched L1 buckets are reclustered.
    Files younger than the stability window (``wait`` may give its seconds) wait
    for a later pass; a known one stays meanwhile.
    """
    spark, now = store.spark, F.lit(time.time()).cast("timestamp")  # one now for the whole pass
    found = files.binary_files(spark, root) if listing is None else listing.select("path", F.date_trunc("millisecond", "modificationTime").alias("modificationTime"), "length")
    listed = table_of(found.withColumn("norm_path", files.same_path(F.col("path"))).dropDuplicates(["norm_path"]))
    ready, young = files.stable(listed, now, STABILITY_SECONDS if wait is True else wait) if wait else (listed, listed.limit(0))
    known = store.read("images").where(F.col("source_id") == source_id)
    wanted = with_contents(spark, root, table_of(to_read(ready, known)))
    parsed = files.with_companion(
        wanted.select("path", "norm_path", "modificationTime", "length", fingerprint("content").alias("content_fp"), files.parse_image("path", "content").alias("meta")),
        files.companions(spark, root),
    )
    read = table_of(image_columns(parsed, source_id, root, dimension))
    plan = planned(known, listed, read, partial(fresh_ids, store), identity_keys)
    again, inserts = plan.again, plan.inserts
    pending = young.join(known.select(F.col("abs_path").alias("norm_path")), "norm_path", "left_anti").count()
    changed = again.where(~F.col("group_key_l1").eqNullSafe(F.col("_l1")) | ~F.col("group_key_l3").eqNullSafe(F.col("_l3")))
    touched = inserts.select("group_key_l1").union(changed.select("group_key_l1")).union(changed.select("_l1")).union(plan.removed.select("group_key_l1"))
    if not again.isEmpty():
        store.update("images", again.drop("_id", "_l1", "_l3", "_fp", "source_id", "abs_path", "group_key_l2", "hidden"))
    if not plan.moves.isEmpty():
        store.update("images", plan.moves)
    if not inserts.isEmpty():
        store.append("images", inserts)
    if not plan.removed.isEmpty():
        store.delete_images(plan.removed.select("id"))
    recluster_touched(store, touched, source_id)
    return Synced(inserts.count(), plan.moves.count(), plan.removed.count(), pending, again.count())


def recluster_touched(store: Store, l1: DataFrame, source_id: int | None = None) -> None:
    """New level-2 keys for the L1 buckets that changed, and only those, in the source's stored mode and threshold (else text)."""
    touched = l1.distinct()
    images = store.read("images").join(touched, "group_key_l1", "left_semi")
    source = store.read("sources").where(F.col("id") == source_id).first() if source_id is not None else None
    mode = (source and source["l2_mode"]) or "text"
    threshold = source and source["l2_threshold" if mode == "text" else f"l2_{mode}_threshold"]
    keys = table_of(recluster(images, store.read("image_signatures"), store.read("manual_group_bindings"), mode, threshold))
    if not keys.isEmpty():
        store.update("images", keys.withColumnRenamed("group_key", "group_key_l2"))


def refresh_templates(store: Store, templates: DataFrame) -> None:
    """Templates into the library, the vanished ones out, and matches for images without one."""
    rows = templates.select(
        F.abs(F.xxhash64("path")).alias("id"), "path", "name", "workflow_id", F.struct("t", "e").alias("graph"), "node_count", "diffusion_models", "model_chain",
        F.substring(F.md5(F.to_json(F.struct("t", "e"))), 1, 16).alias("topology_signature"),
    )
    rows = table_of(rows)
    store.upsert("workflow_templates", rows)
    store.prune_templates(rows)
    images = store.read("images")
    free = images.where(F.col("workflow_template_id").isNull() & (F.coalesce("workflow_key", F.lit("")) != ""))
    graphs = free.groupBy("workflow_key").agg(F.any_value("workflow_graph").alias("g")).select("workflow_key", "g.t", "g.e")
    found = contained(graphs, rows.select(F.col("id").alias("template_id"), "name", "graph.t", "graph.e"))
    assigned = assign_templates(free, found).where(F.col("workflow_template_id").isNotNull())
    store.update("images", assigned.select("id", "workflow_template_id", "workflow_match_confidence"))


@dataclass
class Poller:
    """The streams that keep a library in step with its folders: images every few seconds, templates on a slower trigger.

    Each stream has its own checkpoint under ``checkpoint``, so a restart begins
    where the last finished pass ended: a listing that was processed makes no
    batch again. The watermark is that of settled files only: younger ones are
    listed, so that none seems gone, and parsed with a later listing. Passes take turns (one writer at a time).
    """

    store: Store
    source_id: int
    root: str
    checkpoint: str
    templates: str | None = None
    depth: int = 1
    settle: float = STABILITY_SECONDS
    passes: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self._turn = Lock()

    def _images(self, batch: DataFrame, number: int) -> None:
        with self._turn:
            listing = batch.select("path", F.col("modified_at").alias("modificationTime"), "length")
            self.passes.append((number, sync_source(self.store, self.source_id, self.root, wait=self.settle, listing=listing)))

    def _templates(self, batch: DataFrame, number: int) -> None:
        with self._turn:
            refresh_templates(self.store, templates_of(batch.sparkSession, batch))
            self.passes.append((number, "templates"))

    def start(self, seconds: int = POLL_SECONDS, template_seconds: int = TEMPLATE_SECONDS, once: bool = False) -> list:
        """The running queries; with ``once`` they process what has changed and stop."""
        spark = self.store.spark
        wanted = [("images", self.root, {"depth": self.depth}, self._images, seconds)]
        if self.templates:
            wanted.append(("templates", self.templates, {"depth": TEMPLATE_DEPTH - 1, "suffixes": "json"}, self._templates, template_seconds))
        queries = []
        for name, root, options, each, every in wanted:
            writer = folder_changes(spark, root, settle=self.settle, **options).writeStream.queryName(f"{name}-{self.source_id}")
            writer = writer.option("checkpointLocation", f"{self.checkpoint}/{name}").foreachBatch(each)
            queries.append((writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every} seconds")).start())
        if once:
            for q in queries:
                q.awaitTermination()
        return queries

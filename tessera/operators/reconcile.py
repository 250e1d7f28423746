"""Recovery of state from another library: bindings, labels and scores follow the file matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.identity import match_files
from tessera.store import Store, table_of


@dataclass
class Plan:
    """What recovery would add; each is a DataFrame, nothing is written."""

    matches: DataFrame
    key_map: DataFrame
    bindings: DataFrame
    labels: DataFrame
    scores: DataFrame

    def preview(self) -> DataFrame:
        """Counts of the plan."""
        counts = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, df in vars(self).items()]
        out = counts[0]
        for c in counts[1:]:
            out = out.union(c)
        return out.orderBy("what")


def majority_keys(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_key, new_key): the level-2 key most matched members of an old group have now; ties go to the smallest key."""
    pairs = (
        matches.join(old.select(F.col("id").alias("old_id"), F.col("group_key_l2").alias("old_key")), "old_id")
        .join(new.select(F.col("id").alias("new_id"), F.col("group_key_l2").alias("new_key")), "new_id")
        .where(F.col("old_key").isNotNull() & F.col("new_key").isNotNull())
    )
    counted = pairs.groupBy("old_key", "new_key").agg(F.count("*").alias("n"))
    return counted.groupBy("old_key").agg(F.min_by("new_key", F.struct((-F.col("n")).alias("less"), "new_key")).alias("new_key"))


def plan_recovery(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> Plan:
    """Plan recovery from library ``old`` into ``new`` (tables by name; images carry the identity keys).

    Labels match by name; what the new library already has wins. A binding's
    previous key is carried over only if it is a manual key itself.
    """
    matches = match_files(old["images"], new["images"])
    keys = majority_keys(matches, old["images"], new["images"])
    moved = matches.select(F.col("old_id").alias("image_id"), "new_id")
    manual = old["manual_group_bindings"].select(F.col("group_key").alias("manual")).distinct()
    bindings = (
        old["manual_group_bindings"].join(moved, "image_id")
        .join(keys.select(F.col("old_key").alias("group_key"), "new_key"), "group_key", "left")
        .join(manual, F.col("prev_group_key") == F.col("manual"), "left")
        .select(
            "level", F.col("new_id").alias("image_id"),
            F.when(F.col("kind") == "move", F.coalesce("new_key", "group_key")).otherwise(F.col("group_key")).alias("group_key"),
            "kind", F.col("manual").alias("prev_group_key"),
        )
        .join(new["manual_group_bindings"].select("level", "image_id"), ["level", "image_id"], "left_anti")
    )
    names = old["labels"].select(F.col("id").alias("label_id"), "name").join(new["labels"].select(F.col("id").alias("new_label"), "name"), "name")
    labels = (
        old["image_labels"].join(moved, "image_id").join(names, "label_id")
        .select(F.col("new_id").alias("image_id"), F.col("new_label").alias("label_id")).distinct()
        .join(new["image_labels"], ["image_id", "label_id"], "left_anti")
    )
    scores = (
        old["scores"].join(moved, "image_id").select(F.col("new_id").alias("image_id"), "internal_score", F.lit("recovered").alias("last_mode"))
        .join(new["scores"].select("image_id"), "image_id", "left_anti")
    )
    return Plan(matches, keys, bindings, labels, scores)


def apply(store: Store, plan: Plan) -> None:
    """Write a plan into the new library: bindings with their level-2 keys, labels, scores. What is there already stays."""
    bindings, labels, scores = (table_of(df) for df in (plan.bindings, plan.labels, plan.scores))
    store.insert_absent("manual_group_bindings", bindings)
    store.update("images", bindings.where("level = 2").select(F.col("image_id").alias("id"), F.col("group_key").alias("group_key_l2")))
    store.insert_absent("image_labels", labels)
    store.insert_absent("scores", scores)

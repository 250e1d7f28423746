"""Identity of renamed and recovered files: joins on keys that are unique on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers in the order they are tried: name and key column.
TIERS = (("content_key", "content_key"), ("metadata", "meta_sig"), ("content_hash", "content_fp"))


def unique_join(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, old_id, new_id): rows pair where their key occurs once on either side. Empty and null keys never pair."""

    def once(df: DataFrame, name: str) -> DataFrame:
        keyed = df.where(F.coalesce(F.col(key), F.lit("")) != "")
        return keyed.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")

    return once(old, "old_id").join(once(new, "new_id"), key)


def informative(workflow_key: Column, steps: Column) -> Column:
    """Whether a metadata signature tells files apart at all."""
    return (F.coalesce(workflow_key, F.lit("")) != "") | (F.coalesce(steps, F.lit(0)) > 0)


def match_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, basis): three tiers; uniqueness is over all rows, rows of earlier tiers are left out afterwards.

    old and new have (id, content_key, meta_sig, content_fp); an empty meta_sig
    marks a signature that says nothing.
    """
    found: DataFrame | None = None
    for basis, key in TIERS:
        tier = unique_join(old, new, key).select("old_id", "new_id", F.lit(basis).alias("basis"))
        if found is None:
            found = tier
            continue
        rest = tier.join(found.select("old_id"), "old_id", "left_anti").join(found.select("new_id"), "new_id", "left_anti")
        found = found.union(rest.select("old_id", "new_id", "basis"))
    return found


def basis_histogram(matches: DataFrame) -> DataFrame:
    return matches.groupBy("basis").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "basis")

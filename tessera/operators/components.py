"""Connected components of an edge list by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.store import table_of


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable from each node of ``edges`` (a, b).

    Rounds grow with the logarithm of the diameter; each ends in a table of
    the session's shared folder, so that plans stay short and a lost executor
    costs a re-read.
    """
    both = table_of(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = table_of(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("hop"))
        far = labels.select(F.col("node").alias("hop"), F.col("component").alias("far"))
        step = table_of(hop.join(far, "hop", "left").select("node", F.least("hop", F.coalesce("far", "hop")).alias("component"), "was"))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels

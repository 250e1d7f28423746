"""Workflow graphs: containment in templates and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.store import table_of


def _same(df: DataFrame) -> DataFrame:
    """``df`` with types and edges as sets in order, and a digest of both."""
    sets = df.withColumn("t", F.array_sort(F.array_distinct("t"))).withColumn("e", F.array_sort(F.array_distinct("e")))
    return sets.withColumn("digest", F.sha2(F.to_json(F.struct("t", "e")), 256))


def contained(graphs: DataFrame, templates: DataFrame) -> DataFrame:
    """(workflow_key, template_id, coverage): the best template whose types and edges hold all of the graph's.

    graphs (workflow_key, t, e) and templates (template_id, name, t, e). Graphs
    without edges match nothing. An equal edge set comes first, then the fewest
    further edges, then the name. Equal graphs are one, and so are equal
    templates, of which the first by name stands for all. Candidates come from
    one shared edge, the graph's rarest among templates, so no pair without a
    common edge is built.
    """
    asked = _same(graphs.where(F.size("e") > 0))
    g = table_of(asked.groupBy("digest").agg(F.any_value("t").alias("gt"), F.any_value("e").alias("ge")).withColumnRenamed("digest", "g"))
    first = F.min(F.struct(F.lower("name").alias("name"), "template_id")).alias("first")
    t = table_of(_same(templates).groupBy("digest").agg(first, F.any_value("t").alias("tt"), F.any_value("e").alias("te")).withColumnRenamed("digest", "k"))
    edges = t.select("k", F.explode("te").alias("edge"))
    frequency = edges.groupBy("edge").agg(F.count("*").alias("df"))
    known = g.select("g", F.explode("ge").alias("edge")).join(frequency, "edge", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = known.groupBy("g").agg(F.min_by("edge", F.struct("df", "edge")).alias("edge"))
    pairs = rare.join(edges, "edge").select("g", "k")
    inside = pairs.join(g, "g").join(t, "k").where((F.size(F.array_except("gt", "tt")) == 0) & (F.size(F.array_except("ge", "te")) == 0))
    best = inside.groupBy("g").agg(F.min(F.struct((F.size("te") - F.size("ge")).alias("more"), "first", (F.size("ge") / F.size("te")).alias("coverage"))).alias("m"))
    return asked.select("workflow_key", F.col("digest").alias("g")).join(best, "g").select(
        "workflow_key", F.col("m.first.template_id").alias("template_id"), F.col("m.coverage").alias("coverage")
    )


def assign_templates(images: DataFrame, found: DataFrame) -> DataFrame:
    """Images with the template of their workflow key where they have none yet."""
    new = found.select("workflow_key", F.col("template_id").alias("_t"), F.col("coverage").alias("_c"))
    rows = images.join(new, "workflow_key", "left")
    free = F.col("workflow_template_id").isNull()
    return rows.withColumn("workflow_match_confidence", F.when(free, F.col("_c")).otherwise(F.col("workflow_match_confidence"))).withColumn(
        "workflow_template_id", F.coalesce("workflow_template_id", "_t")
    ).select(*images.columns)

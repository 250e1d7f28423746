"""Prompt recommendation: prompt-and-recipe combinations ranked by shrunken mean score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.constants import BASE_SCORE, CONFIDENCE_PRIOR, EXAMPLES, PAGE_CAP
from tessera.functions.text import raw_tokens


GROUP = ["prompt_pos", "prompt_neg", "recipe_signature"]
#: Columns of the ranking: the first three fall, the group breaks ties.
RANKED = ("shrunk_score", "mean_score", "n")


def _order() -> list[Column]:
    return [*(F.desc(c) for c in RANKED), *(F.asc(c) for c in GROUP)]


def _scored(rows: DataFrame) -> DataFrame:
    """Rows with the base score where they have none; missing texts are empty."""
    return rows.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in GROUP), F.coalesce("score", F.lit(BASE_SCORE)).alias("score"))


def statistics(rows: DataFrame, prior: float = CONFIDENCE_PRIOR) -> DataFrame:
    """Statistics of each prompt, negative prompt and recipe of ``rows`` (id, those, score; score may be null)."""
    stats = _scored(rows).groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.max("score").alias("best_score"), F.avg("score").alias("mean_score"),
        F.median("score").alias("median_score"), F.var_pop("score").alias("variance"),
    )
    confidence = F.col("n") / (F.col("n") + F.lit(prior))
    return stats.withColumn("confidence", confidence).withColumn("shrunk_score", F.col("mean_score") * confidence + BASE_SCORE * (1 - confidence))


def best_examples(rows: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Ids of each group's best rows. The ranked window is limited before its shuffle, so no group is gathered whole."""
    order = W.partitionBy(*GROUP).orderBy(F.desc("score"), F.asc("id"))
    top = _scored(rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= examples)
    listed = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return top.groupBy(*GROUP).agg(F.transform(listed, lambda x: x["id"]).alias("example_ids"))


def recommend(rows: DataFrame, prior: float = CONFIDENCE_PRIOR, examples: int = EXAMPLES) -> DataFrame:
    """Statistics and examples of every group."""
    return statistics(rows, prior).join(best_examples(rows, examples), GROUP)


def page(recommended: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of the ranking: shrunken score, mean, count, then the group itself."""
    return recommended.orderBy(*_order()).offset(max(0, offset)).limit(max(0, min(PAGE_CAP, limit)))


def recommend_prompts(rows: DataFrame, level: int, offset: int = 0, limit: int = 10) -> DataFrame:
    """Recommendations for a group's rows; the individual-prompt level has none.

    Examples are looked up for the page alone, which has at most PAGE_CAP groups.
    """
    own = rows if level < 3 else rows.where(F.lit(False))
    top = page(statistics(own), offset, limit)
    shown = _scored(own).join(F.broadcast(top.select(*GROUP)), GROUP, "left_semi")
    return top.join(best_examples(shown), GROUP).orderBy(*_order())


def common_tokens(prompts: DataFrame) -> DataFrame:
    """Tokens that every one of two or more prompts (column ``prompt_pos``) has."""
    tokens = prompts.select(F.monotonically_increasing_id().alias("p"), F.explode(F.array_distinct(raw_tokens(F.col("prompt_pos")))).alias("token"))
    total = prompts.agg(F.count("*").alias("total"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counted.join(total).where((F.col("n") == F.col("total")) & (F.col("total") >= 2)).select("token").orderBy("token")

"""Score arithmetic of swipes and arena votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.constants import ARENA_DIVISOR, ARENA_K, BASE_SCORE, CLOSE_MATCH, HIGHEST, LOWEST, SWIPE_STEPS


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), score))


def clean(score: Column) -> Column:
    """The score, or the base score where it is null or not finite."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(finite, score).otherwise(F.lit(BASE_SCORE))


def swipe_step(gesture: Column) -> Column:
    """Score change of a gesture; null for others."""
    step = F.lit(None).cast("double")
    for name, by in SWIPE_STEPS.items():
        step = F.when(gesture == name, F.lit(by)).otherwise(step)
    return step


def swiped(score: Column, gesture: Column) -> Column:
    return clamp(F.coalesce(score, F.lit(BASE_SCORE)) + F.coalesce(swipe_step(gesture), F.lit(0.0)))


def arena(left: Column, right: Column, left_won: Column) -> tuple[Column, Column]:
    """Both scores after a vote; expectation is logistic in their difference."""
    expected = 1 / (1 + F.pow(F.lit(10.0), (right - left) / ARENA_DIVISOR))
    change = ARENA_K * (F.when(left_won, 1.0).otherwise(0.0) - expected)
    return clamp(left + change), clamp(right - change)


def close_match(a: Column, b: Column) -> Column:
    """Whether two scores are near enough for the arena; unscored counts as the base score."""
    base = F.lit(BASE_SCORE)
    return F.abs(F.coalesce(a, base) - F.coalesce(b, base)) < CLOSE_MATCH

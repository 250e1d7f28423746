"""Helpers the corpus operators share: shared-folder tables, label samples, components."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components as connected_components  # noqa: F401
from tessera.store import table_of as cut  # noqa: F401

T = TypeVar("T")


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def labelled(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """All labelled ids (doc_id, label): once each, with the largest label; none outside ``usable``, none with a null id or label."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    )


def labelled_sample(labels: DataFrame, label: str, usable: Column, max_docs: int) -> DataFrame:
    """At most about ``max_docs`` labelled ids (doc_id, label), the same ones on every run.

    The sample is a hash threshold, so its expected size is ``max_docs`` and its
    size is bounded whatever the input is; it is therefore safe to broadcast.
    """
    clean = labelled(labels, label, usable)
    total = clean.count()
    if total > max_docs:
        clean = clean.where(in_share("sample", max_docs / total))
    return clean


def in_share(purpose: str, share: float) -> Column:
    """Whether a doc_id's hash lies in a ``share`` of all hashes: a threshold on 62 bits, so no share is too small to hold any."""
    return F.xxhash64(F.lit(purpose), "doc_id").bitwiseAND(F.lit(2**62 - 1)) < F.lit(int(share * 2**62))


_REMEMBERED: dict[str, object] = {}


def remembered(name: str, make: Callable[[], T]) -> T:
    """What an operator remembers from task to task of a Python worker.

    A worker lives through many stages; it keeps the memory of one operator at
    a time, so that their tables do not add up.
    """
    if name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets everything at ``limit`` words."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

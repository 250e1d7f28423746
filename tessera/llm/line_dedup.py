"""Substring dedup by line hashing (operator 9).

A text is cut into pieces: the sentences of its lines. Units are its lines and,
so that a passage set in the middle of a line or broken into short lines is
found too, runs of pieces: from each piece on as many pieces as give
``min_words`` words, and up to each piece as many as do, also across line ends.
A piece of ``min_words`` words is a unit of its own. Ideographs and kana count
as words. A unit's digest is taken from its normalised form (lower-cased, white
space runs as one space, line ends too). Of all units with one digest, the
occurrence earliest in (doc_id, offset) stays; the others are cut out of their
texts. What is cut is always there once more at an earlier place.

Nulls and edges: a null text stays null and has no units; an empty text stays
empty; a text that is nothing but repeats becomes empty, its row stays. A text
of fewer than ``min_words`` words has no units. A null doc_id ranks after all
others. Repeated rows of one doc_id and text are one document: they share one
result. Extra columns are ignored by ``repeats`` and kept by
``without_repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 8
#: A sentence with its closing marks and the blanks that follow it, or the rest of a line.
_SENTENCE = re.compile(r"[^.!?\n。！？…]*[.!?。！？…]+[^\S\n]*|[^.!?\n。！？…]+")
_IDEOGRAPH = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")


class Unit(NamedTuple):
    """Offsets are code points of the text."""

    start: int
    end: int
    form: str


def pieces(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, form, words, line) of each sentence of each line that has a word."""
    out = []
    plain = _IDEOGRAPH.search(text) is None
    at = 0
    for number, line in enumerate(text.split("\n")):
        for m in _SENTENCE.finditer(line):
            tokens = m[0].split()
            if tokens:
                words = len(tokens) if plain else len(tokens) + len(_IDEOGRAPH.findall(m[0]))
                out.append((at + m.start(), at + m.end(), " ".join(tokens).lower(), words, number))
        at += len(line) + 1
    return out


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[Unit]:
    """The units of a text in order."""
    found = pieces(text)
    upto = [0, *accumulate(p[3] for p in found)]
    runs = set()
    for i, p in enumerate(found):
        if p[3] >= min_words:
            runs.add((i, i))
            continue
        j = bisect_left(upto, upto[i] + min_words)  # the first piece up to which there are enough words from i on
        if j <= len(found):
            runs.add((i, j - 1))
        k = bisect_right(upto, upto[i + 1] - min_words) - 1  # the last one from which there are enough up to i
        if k >= 0:
            runs.add((k, i))
    first = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i][4] != found[first][4]:
            if upto[i] - upto[first] >= min_words:
                runs.add((first, i - 1))
            first = i
    for i, j in sorted(runs):
        yield Unit(found[i][0], found[j][1], found[i][2] if i == j else " ".join(p[2] for p in found[i : j + 1]))


_COLUMNS = ("rank", "key", "start", "end", "d1", "d2")


def _units(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[int]] = [[] for _ in _COLUMNS]
        for rank, key, text in zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "text"))):
            for u in units(text or "", min_words):
                d = xxhash.xxh3_128_intdigest(u.form)
                for column, v in zip(out, (rank, key, u.start, u.end, (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=_COLUMNS)


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """The spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], min(s["end"], size)) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s[1])
        else:
            out.append(s)
    return out


def cut_out(text: str, spans: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and what is left of it as original (start, end). Lines of which nothing is left go whole."""
    kept, at = [], 0
    for start, end in merged(spans, len(text)):
        if start > at:
            kept.append((at, start))
        if start == 0 or text[start - 1] == "\n":
            end += text.startswith("\r", end)
            end += text.startswith("\n", end)
        at = max(at, end)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[a:b] for a, b in kept), kept


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, kept = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            if text is None:
                texts.append(None)
                kept.append([])
                continue
            new, left = cut_out(text, spans or [])
            texts.append(new)
            kept.append([{"start": a, "end": b} for a, b in left])
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(kept, spans_type)], names=["rest", "text", "kept"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans to cut: (rank, key, cuts array<struct<start, end>>), one row per document that has any.

    ``rank`` is the doc_id (the largest long for null), ``key`` is xxhash64(doc_id, text).
    """
    last = F.lit(2**63 - 1)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), last).alias("rank"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text"
    )
    # read twice, from the texts: units are cheaper to make again than to keep
    found = rows.mapInArrow(partial(_units, min_words=min_words), ", ".join(f"{c} long" for c in _COLUMNS))
    first = (
        found.groupBy("d1", "d2").agg(F.min(F.struct("rank", "key", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    later = found.join(first, ["d1", "d2"]).where(
        ~((F.col("rank") == F.col("first.rank")) & (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start")))
    )
    return later.groupBy("rank", "key").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, kept: str | None = "_lh_kept") -> DataFrame:
    """``docs``, all columns, with later occurrences cut from ``text``.

    The column named ``kept``, if any, holds the original (start, end) of each piece
    that is left; it takes the place of a column of the caller's of that name.
    """
    cuts = repeats(docs, min_words)
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    keyed = docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("rank"), rest.alias("rest"), "text"
    )
    rows = keyed.join(cuts, ["key", "rank"], "left").select("rest", "text", "cuts")
    schema = T.StructType([
        rows.schema["rest"], T.StructField("text", T.StringType()), T.StructField("kept", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")]))),
    ])
    cleaned = rows.mapInArrow(_cleaned, schema)
    columns = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c != kept]
    return cleaned.select(*columns, *([F.col("kept").alias(kept)] if kept else []))

"""Toxicity by class-conditional Kneser-Ney models (operator 1).

Two language models of the characters of words, one of toxic and one of
ordinary texts. A class's n-gram that has the full order (or starts a word) is
discounted by ``class_discount``; what that frees goes to one shared
interpolated Kneser-Ney model of both classes' texts, whose orders below the
highest are continuation counts. So a rare expression has the same likelihood
in both classes, and only what a class has seen often tells them apart.

A word of a toxic text is a toxic expression at the rate ``rate`` and else an
ordinary word: its likelihood is rate * toxic(word) + (1 - rate) *
ordinary(word), in an ordinary text ordinary(word). The two log-likelihoods of
a text are compared per word (length-normalised), and a logistic curve turns
their difference into a score. The curve alone is fitted on a bounded,
hash-chosen sample (``max_docs``) of the labelled rows; those are not counted,
all others are, so the counts grow with the input.

The log-ratios travel as one table of 2 ** ``bits`` slots with tags, whatever
the number of n-grams; where two n-grams share a slot the one with more counts
has it, and the other counts as unseen.

Nulls and edges: a null text is empty; an empty text shows no difference and
gets the curve's score of none. Without labelled rows of both classes every
score is 0. Rows with a null doc_id are scored and never learned from. Repeated
rows score alike. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_share, labelled, remembered


@dataclass(frozen=True)
class Kneser:
    """Parameters; ``max_docs`` bounds the labelled rows that the curve is fitted on."""

    max_docs: int = 8_000
    order: int = 5
    discount: float = 0.75
    class_discount: float = 2.0
    rate: float = 0.01
    bits: int = 23
    #: At most one labelled row in so many is kept for the curve instead of being counted.
    calibrate: int = 4


_WORD = re.compile(r"\w+")
_START, _END = "\x02", "\x03"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by class of each batch's rows that are counted, and the rows that are held for the curve."""
    for batch in batches:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        held = []
        for text, label, hold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "hold"))):
            if hold:
                held.append((text or "", label))
            else:
                found[1 if label else 0].update(words(text))
        every = list(found[0].keys() | found[1].keys())
        n, m = len(every), len(held)
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(every + [None] * m, pa.string()), "n0": pa.array([found[0][w] for w in every] + [None] * m, pa.int64()),
            "n1": pa.array([found[1][w] for w in every] + [None] * m, pa.int64()), "text": pa.array([None] * n + [t for t, _ in held], pa.string()),
            "label": pa.array([None] * n + [y for _, y in held], pa.int32()),
        })


def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n0, n1 = Counter(), Counter()
        for word, a, b in zip(*(batch.column(c).to_pylist() for c in ("word", "n0", "n1"))):
            s = _START + word + _END
            for j in range(1, len(s)):
                for i in range(max(0, j - order + 1), j + 1):
                    g = s[i : j + 1]
                    n0[g] += a
                    n1[g] += b
        yield pa.RecordBatch.from_pydict({
            "gram": pa.array(list(n0), pa.string()), "n0": pa.array(list(n0.values()), pa.int64()), "n1": pa.array([n1[g] for g in n0], pa.int64()),
        })


def ratios(grams: DataFrame, p: Kneser) -> DataFrame:
    """Log-ratios (gram, whole, weight, ratio) of the toxic to the ordinary model, from counts (gram, n0, n1) of all orders.

    ``whole`` rows are n-grams that have been seen; the others are contexts,
    whose ratio is that of any character never seen after them.
    """
    d, dc = p.discount, p.class_discount
    sized = grams.withColumn("size", F.char_length("gram")).withColumn("top", (F.col("size") == p.order) | F.col("gram").startswith(_START))
    rest = F.expr("substring(gram, 2)")
    before = sized.where("size > 1").groupBy(rest.alias("gram")).agg(F.count("*").alias("before"))  # distinct characters before it
    value = F.when(F.col("top"), F.col("n0") + F.col("n1")).otherwise(F.coalesce("before", F.lit(0)))
    valued = cut(
        sized.join(before, "gram", "left").withColumn("v", value).withColumn("context", F.expr("substring(gram, 1, size - 1)")).where("v > 0")
        .select("gram", "size", "top", "n0", "n1", "v", "context"), "grams",
    )
    own = lambda n, f: F.sum(F.when(F.col("top"), f(F.col(n)))).cast("double")
    contexts = cut(
        valued.groupBy("context").agg(
            F.sum("v").alias("total"), F.count("*").alias("types"),
            *(own(n, lambda x: x).alias(f"total_{n}") for n in ("n0", "n1")), *(own(n, lambda x: F.least(x, F.lit(dc))).alias(f"freed_{n}") for n in ("n0", "n1")),
        ), "contexts",
    )
    rows = valued.join(contexts, "context")
    letters = valued.where("size = 1").agg((F.count("*") + 1).alias("letters"))  # one row
    spread = F.greatest(F.col("v") - d, F.lit(0.0)) / F.col("total"), d * F.col("types") / F.col("total")
    low = rows.where("size = 1").join(F.broadcast(letters)).select("gram", (spread[0] + spread[1] / F.col("letters")).alias("p"))
    every = low
    for size in range(2, p.order + 1):
        level = rows.where(F.col("size") == size).withColumn("below", rest)
        low = cut(level.join(low.withColumnsRenamed({"gram": "below", "p": "q"}), "below").select("gram", (spread[0] + spread[1] * F.col("q")).alias("p")), "level")
        every = every.union(low)

    def likelihood(n: str) -> Column:
        t = F.col(f"total_{n}")
        seen = F.greatest(F.col(n) - dc, F.lit(0.0)) / t + F.col(f"freed_{n}") / t * F.col("p")
        return F.when(t > 0, seen).otherwise(F.col("p"))

    left = lambda n: F.when(F.col(f"total_{n}") > 0, F.col(f"freed_{n}") / F.col(f"total_{n}")).otherwise(1.0)
    whole = rows.where("top").join(every, "gram").select(
        "gram", F.lit(True).alias("whole"), "v", F.ln(likelihood("n1") / likelihood("n0")).alias("ratio")
    )
    unseen = contexts.where("total_n0 is not null").select("context", F.lit(False), "total", F.ln(left("n1") / left("n0")))
    return whole.union(unseen).withColumnRenamed("v", "weight")


def slot(gram: str, whole: bool, bits: int) -> tuple[int, int]:
    """Slot and tag (never 0) of an n-gram or context."""
    h = xxhash.xxh3_64_intdigest(gram, 1 if whole else 2)
    return h >> (64 - bits), (h & 255) | 1


def _slots(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [slot(g, w, bits) for g, w in zip(batch.column("gram").to_pylist(), batch.column("whole").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), *(batch.column(c) for c in ("gram", "weight", "ratio"))],
            names=["slot", "tag", "gram", "weight", "ratio"],
        )


def packed(found: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The log-ratios as tables of tags and ratios by slot; at most 2 ** ``bits`` rows come to the driver."""
    slots = found.mapInArrow(partial(_slots, bits=bits), "slot long, tag int, gram string, weight long, ratio double")
    one = slots.groupBy("slot").agg(F.max_by(F.struct("tag", "ratio"), F.struct("weight", "gram")).alias("m")).select("slot", "m.tag", "m.ratio").toArrow()
    tags, values = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, np.float32)
    at = one.column("slot").to_numpy()
    tags[at], values[at] = one.column("tag").to_numpy(), one.column("ratio").to_numpy()
    return tags, values


class Evidence(dict):
    """word: what a toxic text's log-likelihood of it has over an ordinary text's; remembers the first ``limit`` words."""

    def __init__(self, tags: np.ndarray, values: np.ndarray, p: Kneser, limit: int = 250_000) -> None:
        super().__init__()
        self.tags, self.values, self.p, self.limit = memoryview(tags), memoryview(values), p, limit

    def ratio(self, word: str) -> float:
        """Difference of the two models' log-likelihoods of a word."""
        s, order, bits = _START + word + _END, self.p.order, self.p.bits
        total = 0.0
        for j in range(1, len(s)):
            i = max(0, j - order + 1)
            at, tag = slot(s[i : j + 1], True, bits)
            if self.tags[at] != tag:
                at, tag = slot(s[i:j], False, bits)
                if self.tags[at] != tag:
                    continue
            total += self.values[at]
        return total

    def __missing__(self, word: str) -> float:
        value = math.log1p(self.p.rate * math.expm1(min(self.ratio(word), 50.0)))
        if len(self) < self.limit:
            self[word] = value
        return value


def _difference(text: str | None, by: Evidence) -> float:
    """Difference of a text's two log-likelihoods per word."""
    found = words(text)
    return sum(map(by.__getitem__, found)) / len(found) if found else 0.0


def _model(shared, p: Kneser) -> Evidence:
    return remembered(f"toxicity {shared.value[0]}", lambda: Evidence(*shared.value[1:], p))


def _differences(batches: Iterator[pa.RecordBatch], shared, p: Kneser, keep: str) -> Iterator[pa.RecordBatch]:
    by = _model(shared, p)
    for batch in batches:
        x = np.arcsinh(np.array([_difference(t, by) for t in batch.column("text").to_pylist()], np.float64) / p.rate)
        yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(x, pa.float64())], names=[keep, "x"])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 0.00001) -> tuple[float, float]:
    """Slope and offset of a logistic curve, the slope held back by ``ridge``."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = np.maximum(q * (1 - q), 1e-6)
        g = np.array([np.sum((q - y) * x) + ridge * len(x) * a, np.sum(q - y)])
        h = np.array([[np.sum(w * x * x) + ridge * len(x), np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", p: Kneser = Kneser()) -> DataFrame:
    """(doc_id, score) of every row; learns from labelled rows that are ``usable`` (an expression over doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = cut(labelled(labels, label, usable), "labels")
    held = in_share("hold", min(1 / p.calibrate, p.max_docs / max(1, known.count())))
    # the same plan at every size: texts of usable rows are sorted by doc_id and merged with the labels, once
    train = rows.where(usable).join(known.withColumn("hold", held).hint("merge"), "doc_id").select("text", "label", "hold")
    learned = cut(train.mapInArrow(_learned, "word string, n0 long, n1 long, text string, label int"), "learned")
    summed = cut(learned.where("word is not null").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "words")
    grams = summed.mapInArrow(partial(_grams, order=p.order), "gram string, n0 long, n1 long").groupBy("gram").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *packed(ratios(grams, p), p.bits)))  # 5 * 2 ** bits bytes
    check = learned.where("word is null").select("text", "label").mapInArrow(
        partial(_differences, shared=shared, p=p, keep="label"), "label int, x double"
    ).toArrow()  # at most about max_docs rows
    y = check.column("label").to_numpy().astype(float)
    curve = _logistic(check.column("x").to_numpy(), y) if 0 < y.sum() < len(y) else None
    found = rows.mapInArrow(partial(_differences, shared=shared, p=p, keep="doc_id"), "doc_id long, x double")
    score = F.lit(0.0) if curve is None else 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.lit(curve[0]) * F.col("x") + F.lit(curve[1])))))
    return found.select("doc_id", score.alias("score"))

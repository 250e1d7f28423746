"""Quality classifier (operator 4): hashed word n-gram logistic regression, FTRL-proximal.

Features of a text: its words, its word pairs, and its pairs of word shapes
with a mark where a word repeats the one before; each is hashed into one table
and weighs its share of the text's tokens, so a score is a sparse dot product. The
bias is fixed at the sample's log odds, so a text that shows little is scored
by the share of label 1.

Training takes a bounded, hash-chosen sample of labelled rows (``max_docs``).
The sample is dealt into shards; each shard runs FTRL updates over its rows, in
the order of a hash of doc_id and text, and the shards' states are averaged per
bucket between rounds, in the order of the shards. So the weights do not depend
on how the rows are partitioned or in which order they arrive.

Nulls and edges: a null text is empty; an empty text is scored by the bias
alone. Without any labelled row every score is 0.5. Rows with a null doc_id are
scored and never learned from. Repeated rows score alike. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, labelled_sample, remembered, text_bytes


@dataclass(frozen=True)
class Ftrl:
    """Parameters; ``max_docs`` bounds the labelled rows that are learned from."""

    max_docs: int = 16_000
    bits: int = 18
    shards: int = 8
    rounds: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-5
    scale: float = 20.0


_KIND = bytes.maketrans(
    bytes(range(256)),
    bytes(
        65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256)
    ),
)


def shape(word: bytes) -> bytes:
    """Character kinds of a word with runs shortened: b"Ab12!!" is b"Aa9!"."""
    return bytes(k for k, _ in groupby(word.translate(_KIND)))


class _Words(dict):
    """word: (its hash << 32) | hash of its shape; forgets all at ``limit`` words."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = (xxhash.xxh32_intdigest(word.lower()) << 32) | xxhash.xxh32_intdigest(shape(word), 1)
        return value


def features(text: bytes, bits: int) -> np.ndarray:
    """Bucket of every token feature of the text, under 2 ** bits."""
    tokens = text.split()
    both = np.fromiter(map(remembered("features", _Words).__getitem__, tokens), np.uint64, len(tokens))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    again = (both[1:] == both[:-1]).astype(np.uint64)
    raw = np.concatenate([
        word,
        word[:-1] * np.uint64(0x9E3779B1) + word[1:] * np.uint64(0x85EBCA77) + np.uint64(11),
        (form[:-1] * np.uint64(0xC2B2AE3D) + form[1:] * np.uint64(0x27D4EB2F) + np.uint64(23)) * (np.uint64(1) - again)
        + again * np.uint64(0x165667B1),
    ])
    raw = (raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (raw >> np.uint64(64 - bits)).astype(np.int32)


def _vectors(batches: Iterator[pa.RecordBatch], p: Ftrl) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, by = [], []
        for text in batch.column("text").to_pylist():
            f = features(text, p.bits)
            buckets, n = np.unique(f, return_counts=True)
            at.append(buckets)
            by.append((n * (p.scale / max(1, len(f)))).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("place"), batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(by, pa.list_(pa.float32()))],
            names=["shard", "place", "label", "at", "by"],
        )


def _weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) <= p.l1, 0.0, w)


#: Buckets whose states travel in one row: a state is cut into parts of so many.
PART = 1 << 12
_STATES = "shard int, part int, at array<int>, z array<double>, n array<double>"
_MEANS = "at array<int>, z array<double>, n array<double>"


def _trainer(p: Ftrl, state):
    """One pass over a shard (at most about max_docs / shards rows) from the broadcast state."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _in_parts(_train(rows, p, *state.value))

    return run


def _train(rows: pd.DataFrame, p: Ftrl, bias: float, z0: np.ndarray, n0: np.ndarray) -> pd.DataFrame:
    """One pass of FTRL over a shard from the state (z0, n0); the buckets it has touched."""
    z, n = z0.copy(), n0.copy()
    touched = np.zeros(len(z), bool)
    order = np.argsort(rows["place"].to_numpy(), kind="stable")  # rows of one place are equal
    labels = rows["label"].to_numpy()
    ats, bys = rows["at"].to_numpy(), rows["by"].to_numpy()
    for i in order:
        at, by = ats[i], bys[i].astype(np.float64)
        w = _weights(z[at], n[at], p)
        g = (1 / (1 + np.exp(-np.clip(bias + w @ by, -35, 35))) - labels[i]) * by
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
        n[at] += g * g
        touched[at] = True
    k = np.flatnonzero(touched)
    return pd.DataFrame({"shard": rows["shard"].iloc[0], "bucket": k.astype(np.int32), "z": z[k], "n": n[k]})


def _in_parts(state: pd.DataFrame) -> pd.DataFrame:
    """A shard's state (shard, bucket, z, n), sorted by bucket, with one row a part."""
    bucket, z, n = (state[c].to_numpy() for c in ("bucket", "z", "n"))
    parts, first = np.unique(bucket // PART, return_index=True)
    cut_up = lambda x: pd.Series(np.split(x, first[1:]) if len(first) else [], dtype=object)
    return pd.DataFrame({"shard": state["shard"].to_numpy()[first], "part": parts, "at": cut_up(bucket), "z": cut_up(z), "n": cut_up(n)})


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """The shards' states of a part averaged per bucket, summed in the order of the shards; buckets that no shard has touched are left out."""
    first = int(rows["part"].iloc[0]) * PART
    z, n, shards = np.zeros(PART), np.zeros(PART), np.zeros(PART)
    for _, at, dz, dn in sorted(zip(rows["shard"], rows["at"], rows["z"], rows["n"]), key=lambda r: r[0]):
        z[at - first] += dz
        n[at - first] += dn
        shards[at - first] += 1
    k = np.flatnonzero(shards)
    return pd.DataFrame({"at": [(k + first).astype(np.int32)], "z": [z[k] / shards[k]], "n": [n[k] / shards[k]]})


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", p: Ftrl = Ftrl()) -> np.ndarray:
    """Weights by bucket and, last, the bias, learned from labelled rows of ``docs`` that are ``usable`` (an expression over doc_id)."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    sample = labelled_sample(labels, label, usable, p.max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    # at most about max_docs rows of two numbers
    train = rows.join(F.broadcast(sample), "doc_id").select(
        F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(p.shards)).cast("int").alias("shard"), F.xxhash64(F.lit("place"), "doc_id", "text").alias("place"),
        "label", "text",
    )
    vectors = cut(train.mapInArrow(partial(_vectors, p=p), "shard int, place long, label int, at array<int>, by array<float>"), "vectors")
    ones, total = vectors.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    bias = float(np.log((ones + 1) / (total - ones + 1)))
    for _ in range(p.rounds):
        state = docs.sparkSession.sparkContext.broadcast((bias, z, n))  # 2 ** bits numbers each
        ran = vectors.groupBy("shard").applyInPandas(_trainer(p, state), _STATES)
        means = ran.groupBy("part").applyInPandas(_averaged, _MEANS).toArrow()  # at most 2 ** bits numbers each, however many shards
        state.destroy()
        at, new_z, new_n = (pc.list_flatten(means.column(c)).to_numpy() for c in ("at", "z", "n"))
        z[at], n[at] = new_z, new_n  # a bucket that no shard has touched keeps the state it began with
    return np.append(_weights(z, n, p), bias).astype(np.float32)


def _scores(batches: Iterator[pa.RecordBatch], weights, p: Ftrl) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            f = features(text, p.bits)
            out.append(float(w[-1]) + float(w[f].sum(dtype=np.float64)) * p.scale / max(1, len(f)))
        score = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -35, 35)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])


def _rows_scored(docs: DataFrame, weights: np.ndarray, p: Ftrl, keep: list[str]) -> DataFrame:
    """(row, score): the columns ``keep`` as a struct, so that their names cannot clash with this module's."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), text_bytes().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits floats
    return packed.mapInArrow(partial(_scores, weights=shared, p=p), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, weights: np.ndarray, p: Ftrl = Ftrl(), keep: list[str] | None = None, name: str = "_q_score") -> DataFrame:
    """``docs`` (all columns, or ``keep``) with the column ``name``: 0 to 1, higher is likelier label 1.

    It takes the place of a column of the caller's of that name.
    """
    columns = keep if keep is not None else docs.columns
    found = _rows_scored(docs, weights, p, columns)
    return found.select(*(F.col("row").getField(c).alias(c) for c in columns if c != name), F.col("score").alias(name))


def accepted(docs: DataFrame, weights: np.ndarray, p: Ftrl = Ftrl(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more."""
    return _rows_scored(docs, weights, p, docs.columns).where(F.col("score") >= least).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

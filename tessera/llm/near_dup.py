"""MinHash near-duplicates by tensored banding (operator 6).

Two small collections of ``m`` minhash groups, ``t`` minhashes each, are
combined pairwise into ``m * m`` table keys: 2 m t minhash functions do the
work of 2 m^2 t. Texts with equal shingle sets are one class from the start;
classes that meet in a table are verified on their full sets.

Nulls and edges: a null text is empty; a text without words has an empty set
and is linked with nothing; a text with fewer words than a shingle has its
whole word sequence as its one shingle. Rows with a null doc_id are linked
with nothing and kept. Repeated rows of one doc_id and text share one result.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, connected_components, cut, remembered, text_bytes


@dataclass(frozen=True)
class Banding:
    """Parameters. A pair at the threshold of 0.8 meets with probability 0.9985 by default."""

    words: int = 5
    percent: int = 80
    group: int = 3
    groups: int = 10
    seed: int = 7


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; A-Z lower-cased, ASCII white space splits."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(remembered("words", WordHashes).__getitem__, tokens), np.uint64, n)
    size = min(words, n)
    acc = _mix(h[: n - size + 1] + np.uint64(size))
    for j in range(1, size):
        acc = _mix(acc * np.uint64(3) + h[j : n - size + 1 + j])
    return np.unique(acc)


def _coefficients(p: Banding) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    k = 2 * p.groups * p.group
    return rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def group_hashes(shingles: np.ndarray, p: Banding, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 2 m group hashes of a set: each mixes ``t`` minhashes."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):  # long texts in pieces: bounded memory
        part = shingles[at : at + 4096]
        low = np.minimum(low, _spread(part, a, b).min(axis=1))
    low = low.reshape(2 * p.groups, p.group)
    acc = np.zeros(2 * p.groups, np.uint64)
    for j in range(p.group):
        acc = _mix(acc * np.uint64(3) + low[:, j])
    return acc


def _spread(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = part[None, :] * a[:, None] + b[:, None]
    return x ^ (x >> np.uint64(32))


def _sketches(batches: Iterator[pa.RecordBatch], p: Banding) -> Iterator[pa.RecordBatch]:
    a, b = _coefficients(p)
    for batch in batches:
        n, sigs, groups = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, p.words)
            n.append(len(s))
            sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
            groups.append(group_hashes(s, p, a, b).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(groups, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "sig", "groups"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["vid", "n", "shingles"],
        )


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(u) + len(v) - len(np.union1d(u, v))
            keep.append(100 * both >= percent * (len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """Near-duplicate classes: doc_id, n_shingles, sig (digest of the set), component_id, kept."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    sketch = cut(
        source.mapInArrow(partial(_sketches, p=p), "doc_id long, n_shingles long, sig binary, groups array<long>"), "sketch"
    )
    classes = (
        sketch.where("n_shingles > 0 and doc_id is not null")
        .groupBy("sig").agg(F.min("doc_id").alias("vid"), F.any_value("groups").alias("groups"))
    )
    classes = cut(classes, "classes")
    met = cut(_met_with_leader(classes, p), "met")
    pairs = met.select("a", "b").distinct()
    sets = cut(_candidate_sets(source, met, p), "sets")
    links = cut(_verified(pairs, sets, p), "links")
    component = cut(connected_components(links), "component")
    more = cut(_verified(_leftover(met, component, sets, p), sets, p), "links")
    if not more.isEmpty():
        component = connected_components(links.union(more))
    lookup = classes.select("sig", "vid").join(component, F.col("vid") == F.col("node"), "left").select(
        "sig", F.coalesce("component", "vid").alias("component")
    )
    linkable = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("sig"))
    return (
        sketch.select("doc_id", "n_shingles", "sig", linkable.alias("link_sig"))
        .join(lookup.withColumnRenamed("sig", "link_sig"), "link_sig", "left")
        .select("doc_id", "n_shingles", "sig", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def _met_with_leader(classes: DataFrame, p: Banding) -> DataFrame:
    """Rows (key, a, b): class b shares the table key with the key's first class a."""
    m = p.groups
    tables = classes.select("vid", "groups", F.explode(F.sequence(F.lit(0), F.lit(m * m - 1))).alias("k"))
    keyed = tables.select(
        "vid",
        F.xxhash64(
            "k", F.element_at("groups", (F.col("k") / m).cast("int") + 1), F.element_at("groups", F.col("k") % m + (m + 1))
        ).alias("key"),
    )
    first = F.first("vid").over(W.partitionBy("key").orderBy("vid").rowsBetween(W.unboundedPreceding, 0))
    return keyed.select("key", "vid", first.alias("a")).where("vid <> a").select("key", "a", F.col("vid").alias("b"))


def _candidate_sets(source: DataFrame, met: DataFrame, p: Banding) -> DataFrame:
    """Full shingle sets (vid, n, shingles) of the classes that met another."""
    vids = met.select(F.col("a").alias("vid")).union(met.select(F.col("b").alias("vid"))).distinct()
    texts = source.join(vids.hint("shuffle_hash"), source.doc_id == vids.vid, "left_semi").select(F.col("doc_id").alias("vid"), "text")
    return texts.mapInArrow(partial(_sets, words=p.words), "vid long, n long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, p: Banding) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    low = sets.select(F.col("vid").alias("a"), F.col("n").alias("na"))
    high = sets.select(F.col("vid").alias("b"), F.col("n").alias("nb"))
    sized = pairs.join(low, "a").join(high, "b").where(100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb")).select("a", "b")
    full = (
        sized.join(sets.select(F.col("vid").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("vid").alias("a"), F.col("shingles").alias("sa")), "a")
    )
    return full.select("a", "b", "sa", "sb").mapInArrow(partial(_linked, percent=p.percent), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part.column("vid").to_numpy(), n)), pa.array(np.repeat(part.column("comp").to_numpy(), n)),
                    pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets)),
                ],
                names=["vid", "comp", "n", "token"],
            )


def _leftover(met: DataFrame, component: DataFrame, sets: DataFrame, p: Banding) -> DataFrame:
    """Pairs of different components, among the classes that share a table key, that may still be linked.

    A key whose classes are all in one component is done, and so is a key of
    two classes, which have been compared. The classes of the others are joined
    by a positional prefix filter, which loses no pair over the threshold: with
    all shingles in one order, rarest first, such a pair shares one of the
    first n - ceil(s n) + 1 shingles of either, with enough shingles after it.
    Per shingle only the classes outside its largest component meet the rest.
    """
    members = met.select("key", F.col("a").alias("vid")).distinct().union(met.select("key", F.col("b").alias("vid")))
    rows = members.join(component, F.col("vid") == F.col("node"), "left").select("key", "vid", F.coalesce("component", "vid").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).where("x < y and k > 2")
    active = cut(rows.join(mixed.select("key"), "key").select("vid", "comp").distinct(), "active")
    tokens = cut(sets.join(active, "vid").select("vid", "comp", "shingles").mapInArrow(_tokens, "vid long, comp long, n long, token long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"))
    position = F.row_number().over(W.partitionBy("vid").orderBy("df", "token"))
    s = p.percent / 100
    prefix = (
        tokens.join(shared, "token").withColumn("pos", position)
        .where((F.col("df") > 1) & (F.col("pos") <= F.col("n") - F.ceil(s * F.col("n") - 1e-9) + 1))
        .select("token", "vid", "comp", "n", "pos")
    )
    prefix = cut(prefix, "prefix")
    sizes = prefix.groupBy("token", "comp").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select(
        "token", F.col("m.comp").alias("most")
    )
    rest = prefix.join(largest, "token").select("token", "most", *(F.col(c).alias(f"{c}_r") for c in ("vid", "comp", "n", "pos")))
    minor = rest.where("comp_r <> most").select("token", *(F.col(f"{c}_r").alias(f"{c}_m") for c in ("vid", "comp", "n", "pos")))
    enough = 1 + F.least(F.col("n_m") - F.col("pos_m"), F.col("n_r") - F.col("pos_r")) >= s / (1 + s) * (F.col("n_m") + F.col("n_r")) - 1e-9
    once = (F.col("comp_r") == F.col("most")) | (F.col("vid_m") < F.col("vid_r"))
    met_here = minor.join(rest, "token").where((F.col("comp_m") != F.col("comp_r")) & once & enough)
    return met_here.select(F.least("vid_m", "vid_r").alias("a"), F.greatest("vid_m", "vid_r").alias("b")).distinct()


def keep_one(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each near-duplicate class.

    Rows that repeat a doc_id and a text are one document; of texts that share a
    doc_id all stay, if the id is kept.
    """
    decided = near_duplicates(docs, p).where("kept and doc_id is not null").select("doc_id").distinct()
    packed = docs.select(  # a struct, so that no column of the caller's clashes
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    )
    with_id = packed.where("doc_id is not null").join(decided.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"])
    kept = with_id.select("row").union(packed.where("doc_id is null").select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

"""Near-duplicate vectors by E8 lattice hashing (operator 7).

In each of ``tables`` tables a vector is projected at random to 8 dimensions
and decoded to the nearest point of a scaled E8 lattice: its home cell. It is
also entered in the ``probes`` neighbouring cells (home plus a minimal vector
of E8) that its residual points to. Two vectors meet where the home of one is
the home or a probed cell of the other; cosine is then verified in double
precision. At cosine 0.95 and the defaults a pair is missed with a probability
near 2e-5.

A pair is counted only where it meets first (by table, then home before probe,
then the smaller id's probe), so links are counted without listing pairs, and
a cell's links are passed on as one label per vector. Cells with more than
``block`` entries are split into blocks, and block pairs are separate groups.
Equal vectors are one class with a weight from the start.

Nulls and edges: vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link. A null
vec_id stays null. Repeated rows are copies that link with each other. Extra
columns are ignored. An empty table gives an empty result. More vectors fill
the cells: lower ``scale`` (and raise ``tables``) as the table grows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut


@dataclass(frozen=True)
class Lattice:
    cosine: float = 0.95
    tables: int = 5
    probes: int = 4
    scale: float = 0.6
    block: int = 4096
    seed: int = 11


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [
        [a if k == i else b if k == j else 0.0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)
    ]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum (the lattice D8)."""
    r = np.rint(x)
    odd = r.sum(axis=1) % 2 != 0
    off = x - r
    far = np.abs(off).argmax(axis=1)
    at = np.arange(len(x))
    r[at, far] += np.where(odd, np.where(off[at, far] >= 0, 1.0, -1.0), 0.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the better of D8 and D8 shifted by one half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@cache
def _projection(dims: int, table: int, p: Lattice) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([p.seed, dims, table])
    width = max(dims, 8)
    q = np.linalg.qr(rng.normal(size=(width, 8)))[0][:dims]
    return q * (np.sqrt(width / 8) / p.scale), rng.normal(size=8)


def _cell_hash(points: np.ndarray) -> np.ndarray:
    """31-bit hash of lattice points; doubled they are integers."""
    acc = np.zeros(points.shape[:-1], np.uint64)
    whole = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    for k in range(8):
        acc = (acc ^ whole[..., k]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return (acc >> np.uint64(33)).astype(np.int32)


def cells(unit: np.ndarray, p: Lattice) -> np.ndarray:
    """Cell hashes (vectors, tables, 1 + probes): the home first."""
    out = np.zeros((len(unit), p.tables, 1 + p.probes), np.int32)
    short = minimal_vectors()
    for t in range(p.tables):
        a, b = _projection(unit.shape[1], t, p)
        x = unit @ a + b
        home = decode(x)
        out[:, t, 0] = _cell_hash(home)
        toward = np.argpartition(-((x - home) @ short.T), p.probes - 1, axis=1)[:, : p.probes]
        out[:, t, 1:] = _cell_hash(home[:, None, :] + short[toward])
    return out


def _by_dims(batches: Iterator[pa.RecordBatch], p: Lattice) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the rows of one vector length: batch, places in it, vectors, cells."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            vectors = batch.column("vector").to_pylist()
            for dims in sorted({len(v) for v in vectors}):
                own = np.array([k for k, v in enumerate(vectors) if len(v) == dims])
                x = np.array([vectors[k] for k in own], np.float64)
                big = np.abs(x).max(axis=1, keepdims=True)  # lengths of huge or tiny vectors stay finite
                x = x / big
                yield batch, own, x, cells(x / np.linalg.norm(x, axis=1, keepdims=True), p)


def _cells_of(batches: Iterator[pa.RecordBatch], p: Lattice) -> Iterator[pa.RecordBatch]:
    for batch, own, x, found in _by_dims(batches, p):
        n, t, c = found.shape
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), c), n)), pa.array(np.full(found.size, x.shape[1], np.int32)),
                pa.array(found.reshape(-1)), pa.array(np.tile(np.arange(c, dtype=np.int32), n * t)),
                pa.array(np.repeat(batch.column("id").to_numpy()[own], t * c)),
            ],
            names=["t", "dims", "cell", "place", "id"],
        )


def _entered(batches: Iterator[pa.RecordBatch], p: Lattice) -> Iterator[pa.RecordBatch]:
    """One row per vector, table, cell and pair of blocks; the vector and all its cells travel along."""
    for batch, own, x, found in _by_dims(batches, p):
        n, t, c = found.shape
        ids, weights = batch.column("id").to_numpy()[own], batch.column("weight").to_numpy()[own]
        blocks = np.ones((n, t, c), np.int64)
        splits = batch.column("splits").to_pylist()
        for row, k in enumerate(own):
            for s in splits[k] or ():
                blocks[row, s["t"], s["place"]] = s["blocks"]
        blocks = blocks.reshape(-1)
        entry = np.repeat(np.arange(n * t * c), blocks)
        other = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row = entry // (t * c)
        side = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[entry]
        packed = [v.astype("<f8").tobytes() for v in x]
        codes = [v.tobytes() for v in found]
        ints = lambda v: pa.array(v.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                ints(entry // c % t), ints(np.full(len(entry), x.shape[1])), ints(found.reshape(-1)[entry]), ints(entry % c),
                pa.array(ids[row]), pa.array(weights[row]), pa.array([packed[k] for k in row], pa.binary()),
                pa.array([codes[k] for k in row], pa.binary()), ints(side), ints(np.minimum(side, other)), ints(np.maximum(side, other)),
            ],
            names=["t", "dims", "cell", "place", "id", "weight", "vector", "codes", "side", "low", "high"],
        )


def _first_meeting(t: int, ci: np.ndarray, cj: np.ndarray, pi: np.ndarray, pj: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether pairs that share this cell of table t (at places pi, pj) have met nowhere before.

    ci, cj: the cells (pairs, tables, 1 + probes) of either side; lower: whether i has the smaller id.
    """
    met = np.zeros(len(ci), bool)
    for u in range(t):
        met |= (ci[:, u, :1] == cj[:, u]).any(axis=1) | (cj[:, u, :1] == ci[:, u]).any(axis=1)
    same_home = ci[:, t, 0] == cj[:, t, 0]
    i_probes_j = (ci[:, t, 1:] == cj[:, t, :1]).any(axis=1)
    j_probes_i = (cj[:, t, 1:] == ci[:, t, :1]).any(axis=1)
    here_home = (pi == 0) & (pj == 0)
    i_here, j_here = (pi > 0) & (pj == 0), (pj > 0) & (pi == 0)
    first = here_home | ~same_home & (i_here & (lower | ~j_probes_i) | j_here & (~lower | ~i_probes_j))
    return first & ~met


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one key at a time from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and any(held[-1].column(c)[0] != batch.column(c)[a] for c in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _linked(batches: Iterator[pa.RecordBatch], p: Lattice, tile: int = 512) -> Iterator[pa.RecordBatch]:
    """Per vector of a cell (or pair of blocks): links first met here, and the smallest id of its part."""
    for run in _runs(batches, ["t", "dims", "cell", "low", "high"]):
        place = run.column("place").to_numpy()
        if len(place) < 2 or not (place == 0).any():
            continue
        t, low, high = run.column("t")[0].as_py(), run.column("low")[0].as_py(), run.column("high")[0].as_py()
        ids, weight, side = (run.column(c).to_numpy() for c in ("id", "weight", "side"))
        x = np.frombuffer(b"".join(run.column("vector").to_pylist()), "<f8").reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(axis=1))
        codes = np.frombuffer(b"".join(run.column("codes").to_pylist()), np.int32).reshape(len(ids), p.tables, -1)
        links, label, told = np.zeros(len(ids), np.int64), ids.copy(), ids.copy()
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        homes = np.flatnonzero(place == 0)
        for a in range(0, len(homes), tile):
            i = homes[a : a + tile]
            for b in range(0, len(ids), tile):
                j = np.arange(b, min(b + tile, len(ids)))
                close = (x[i] @ x[j].T) >= p.cosine * (norm[i][:, None] * norm[j][None, :]) * (1 - 1e-9)
                r, c = np.nonzero(close)
                r, c = i[r], j[c]
                # a pair of homes once, a home and a probing entry always from the home's side
                new = (ids[r] != ids[c]) & ((place[c] > 0) | (r < c)) & ((low == high) | (side[r] != side[c]))
                r, c = r[new], c[new]
                fine = np.einsum("kd,kd->k", x[r], x[c]) / (norm[r] * norm[c]) >= p.cosine
                r, c = r[fine], c[fine]
                first = _first_meeting(t, codes[r], codes[c], place[r], place[c], ids[r] < ids[c])
                r, c = r[first], c[first]
                if not len(r):
                    continue
                np.add.at(links, r, weight[c])
                np.add.at(links, c, weight[r])
                while (label[r] != label[c]).any():
                    np.minimum.at(label, r, label[c])
                    np.minimum.at(label, c, label[r])
                changed = np.flatnonzero(label != told)
                edges.append((ids[changed], label[changed]))
                told = label.copy()
        some = np.flatnonzero(links)
        out = [ids[some], *(e[0] for e in edges)], [links[some], *(np.zeros(len(e[0]), np.int64) for e in edges)], [ids[some], *(e[1] for e in edges)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["id", "links", "label"])


def near_vectors(vectors: DataFrame, p: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    usable = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    named = source.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h1", F.xxhash64("embedding")).withColumn(
        "h2", F.xxhash64(F.lit(1), "embedding")
    )
    classes = cut(
        named.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.any_value("embedding").alias("vector")),
        "vectors",
    )
    entries = classes.select("id", "weight", "vector").join(_splits(classes, p), "id", "left").mapInArrow(
        partial(_entered, p=p),
        "t int, dims int, cell int, place int, id long, weight long, vector binary, codes binary, side int, low int, high int",
    )
    keys = ["t", "dims", "cell", "low", "high"]
    met = entries.repartition(*keys).sortWithinPartitions(*keys, "id", "place").mapInArrow(partial(_linked, p=p), "id long, links long, label long")
    met = cut(met, "met")
    component = connected_components(met.select(F.col("id").alias("a"), F.col("label").alias("b")))
    found = classes.select("h1", "h2", "id", "weight").join(
        met.groupBy("id").agg(F.sum("links").alias("links")), "id", "left"
    ).join(component, F.col("id") == F.col("node"), "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    key = [F.when(F.col("ok"), F.col(h)).alias(h) for h in ("h1", "h2")]
    joined = named.select("vec_id", *key).join(found, ["h1", "h2"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def _splits(classes: DataFrame, p: Lattice) -> DataFrame:
    """(id, splits): for the entries in cells of more than ``block`` entries, how many blocks their cell has."""
    light = cut(classes.select("id", "vector").mapInArrow(partial(_cells_of, p=p), "t int, dims int, cell int, place int, id long"), "cells")
    cell = ["t", "dims", "cell"]
    hot = light.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > p.block).select(
        *cell, F.ceil(F.col("n") / p.block).cast("int").alias("blocks")
    )
    return light.join(hot, cell).groupBy("id").agg(F.collect_list(F.struct("t", "place", "blocks")).alias("splits"))

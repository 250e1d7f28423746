"""Similarity joins, outliers and move suggestions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import VISUAL_THRESHOLD
from tessera.operators import blocks
from tessera.operators.blocks import against_chunks, block_products, by_block_pair, placed_table
from tessera.store import table_of

#: Tokens are hashed to so many numbers; the most frequent ones, so many, are ordered by how frequent they are.
_MARKS, _RANKED = 2**22, 2**16
#: Of so many tokens of a set one more is looked for among its rare ones than two alike sets must share there, so that few others are counted whole.
_SPARE = 25


def _hashed_tokens() -> Column:
    return F.transform("tokens", lambda x: F.pmod(F.xxhash64(x), F.lit(_MARKS)).cast("int"))


def fold_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal token sets of a bucket as one: members (bucket, id, rep, n), the rows' own sets (bucket, id, digest, tokens), and those that stand for equal ones, to be read once, hashed as ``_ranked`` (bucket, id, digest, n, h), ``id`` the least of a set's.

    Digests and hashes are written; tokens never are, they are made from ``rows`` again where they are read.
    """
    own = rows.select("bucket", "id", F.sort_array(F.array_distinct("tokens")).alias("tokens")).where(F.col("tokens").isNotNull())
    own = own.select("bucket", "id", F.unhex(F.sha2(F.concat_ws("\x1f", "tokens"), 256)).alias("digest"), "tokens")
    keyed = table_of(own.select("bucket", "id", "digest", F.size("tokens").alias("n"), _hashed_tokens().alias("h")))
    reps = table_of(keyed.groupBy("bucket", "digest").agg(F.min("id").alias("rep")))
    hashed = keyed.join(reps.withColumnRenamed("rep", "id"), ["bucket", "id", "digest"], "left_semi")
    if not keyed.groupBy("bucket", "id", "digest").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        own, hashed = own.dropDuplicates(["bucket", "id", "digest"]), hashed.dropDuplicates(["bucket", "id"])
    members = keyed.select("bucket", "id", "digest", "n").join(reps, ["bucket", "digest"]).select("bucket", "id", "rep", "n")
    return members, own, _rare_first(hashed.where("n > 0"), keyed)


def set_pairs(sets: DataFrame, threshold: float, hashed: DataFrame | None = None) -> DataFrame:
    """Pairs (bucket, a, b, sim), a < b, of different non-empty ``sets`` (bucket, id, tokens) with Jaccard >= threshold > 0.

    Sets are placed by bucket and size and streamed past chunks of them, so a
    set meets the smaller ones of its bucket that are large enough; candidates
    never leave their task. A chunk is an index of its sets by their rare tokens, so sets
    meet where they share some; those that share enough of them are counted on all hashed tokens, and what is left is
    checked on the whole sets, of which only those with a candidate are made and written. ``hashed``: the same sets as ``fold_sets`` gives them.
    """
    t = threshold
    named = F.col("bucket").isNotNull() & F.col("id").isNotNull()
    same = ["bucket", "id", *(["digest"] if hashed is not None else [])]
    if hashed is None:
        own = table_of(sets.select("bucket", "id", F.size("tokens").alias("n"), _hashed_tokens().alias("h")).where(F.col("n") > 0))
        hashed = _rare_first(own, own)
    placed = placed_table(hashed.where(named), [F.asc("bucket"), F.asc("n"), F.asc("id")])
    met = against_chunks(placed, 2 * F.col("n"), partial(_sharing, t=t), "bucket string, a bigint, b bigint", later=True, slabs=4 * blocks.SLABS)
    linked = table_of(met.select("bucket", F.col("a").alias("id")).union(met.select("bucket", F.col("b"))).distinct())
    if "digest" in same:
        linked = table_of(placed.select(*same).join(linked, ["bucket", "id"], "left_semi"))
    few = sets.where(F.col("id").isin(linked.select("id")))  # unlike a join this goes below the making of tokens
    tokens = table_of(few.select(*same, F.to_json("tokens").alias("w"))).join(linked, same, "left_semi")  # one text, as arrays of short ones travel at thrice the size
    ta, tb = (tokens.select("bucket", F.col("id").alias(k), F.col("w").alias(f"w{k}")) for k in ("a", "b"))
    both = met.join(ta, ["bucket", "a"]).join(tb, ["bucket", "b"])
    return both.mapInArrow(_similarity, "bucket string, a bigint, b bigint, sim double").where(F.col("sim") >= t)


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard of two sets (JSON texts wa, wb); where neighbouring rows have the same wb it is read once."""
    text, own = None, set()
    for batch in batches:
        sim = []
        for wa, wb in ((a.as_py(), b.as_py()) for a, b in zip(batch.column("wa"), batch.column("wb"))):
            if wb != text:
                text, own = wb, set(json.loads(wb))
            other = json.loads(wa)
            both = len(own.intersection(other))
            sim.append(both / (len(own) + len(other) - both))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "a", "b")), pa.array(sim, pa.float64())], names=["bucket", "a", "b", "sim"])


def _rare_first(hashed: DataFrame, counted: DataFrame) -> DataFrame:
    """``hashed`` with the hashes of each row numbered and sorted from rare to frequent ones in ``counted``.

    Every task counts all its hashes and names its most frequent ones; the order of the others is any. It only decides how long lists in a chunk's index are.
    """
    most = counted.where("n > 0").select("h").mapInArrow(_most_frequent, "h int, k bigint").groupBy("h").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "h").limit(_RANKED)
    top = most.select("h").toArrow().column("h").to_numpy()  # 256 KB at most
    return hashed.mapInArrow(partial(_ranked, top=top), hashed.schema)


def _most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(_MARKS, np.int64)
    for batch in batches:
        count += np.bincount(_lists(batch, "h")[0], minlength=_MARKS)
    top = np.argpartition(count, -_RANKED)[-_RANKED:]
    top = top[count[top] > 0]
    yield pa.RecordBatch.from_arrays([pa.array(top, pa.int32()), pa.array(count[top], pa.int64())], names=["h", "k"])


def _ranked(batches: Iterator[pa.RecordBatch], top: np.ndarray) -> Iterator[pa.RecordBatch]:
    rank = np.arange(_MARKS, dtype=np.int32)
    rank[top] = _MARKS + np.arange(len(top))[::-1]
    for batch in batches:
        h, at = _lists(batch, "h")
        own = np.repeat(np.arange(batch.num_rows) * 2 * _MARKS, np.diff(at))
        own += rank[h]
        own.sort()
        own &= 2 * _MARKS - 1
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own, pa.int32()))
        yield pa.RecordBatch.from_arrays([lists if c == "h" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def _lists(table: pa.Table | pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one after another, and where each row's begin (and the last one's end)."""
    chunk = table.column(column)
    chunk = chunk.combine_chunks() if isinstance(chunk, pa.ChunkedArray) else chunk
    ends = chunk.offsets.to_numpy()
    return chunk.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def _tokens(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of these rows, one row after another, and how many each has."""
    size = at[rows + 1] - at[rows]
    return h[np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def _left_out(least: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the most frequent tokens of sets of ``n`` are not looked for at first, where a pair must share ``least``."""
    return np.clip(np.floor(least - 1e-9).astype(np.int64) - 1 - n // _SPARE, 0, n - 1)


class _Index:
    """A chunk's sets by the rare tokens of each."""

    def __init__(self, chunk: pa.Table, t: float) -> None:
        self.ids, self.place = (chunk.column(c).to_numpy() for c in ("id", "position"))
        self.n = chunk.column("n").to_numpy().astype(np.int64)
        self.h, self.at = _lists(chunk, "h")
        names, first, bucket = np.unique(np.array(chunk.column("bucket").to_pylist(), object), return_index=True, return_inverse=True)
        self.bucket = dict(zip(names, range(len(names))))
        self.starts, self.ends = first, first + np.bincount(bucket)  # a bucket's rows are neighbours
        self.out = _left_out(2 * t / (1 + t) * self.n, self.n)
        rare = self.n - self.out
        row = np.repeat(np.arange(len(rare), dtype=np.int32), rare)
        at = np.repeat((self.at[:-1] - np.cumsum(rare) + rare).astype(np.int32), rare)
        at += np.arange(len(row), dtype=np.int32)
        key = (bucket.astype(np.int64) * 2 * _MARKS)[row]  # in place from here, as a worker holds little
        key += self.h[at]
        del at
        bits = len(rare).bit_length()
        key <<= bits
        key += row
        del row
        key.sort()
        small = np.min_scalar_type(len(rare))  # as they are copied for every row that asks
        self.rows = key.astype(small) & small.type(2**bits - 1)
        key >>= bits
        self.lists = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        self.keys = key[self.lists[:-1]]

    def counts(self, bucket: int, tokens: np.ndarray, upto: int) -> np.ndarray | None:
        """How many of these tokens are among the rare ones of each row before ``upto``; None if of no row."""
        own = bucket * 2 * _MARKS + tokens.astype(np.int64)
        at = np.searchsorted(self.keys, own)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == own]
        if not len(at):
            return None
        return np.bincount(np.concatenate([self.rows[i:j] for i, j in zip(self.lists[at].tolist(), self.lists[at + 1].tolist())]), minlength=upto)


def _sharing(batches: Iterator[pa.RecordBatch], shared: Broadcast, t: float) -> Iterator[pa.RecordBatch]:
    """Pairs (bucket, a, b) of the rows with smaller ones of the chunk that may share enough tokens: none that do are lost.

    Two sets share at least ``part`` of both sizes. Of their rarest tokens, all but those left out of one or the other, they then
    share what is left of that, as the shared ones up to the last looked for of either are looked for in both.
    """
    if not hasattr(shared, "index"):  # the tasks of a worker share it
        shared.index = _Index(shared.value, t)
    x: _Index = shared.index
    part = t / (1 + t)
    marks = np.zeros(2 * _MARKS, bool)
    for batch in batches:
        rid, rplace = (batch.column(c).to_numpy() for c in ("id", "position"))
        rn = batch.column("n").to_numpy().astype(np.int64)
        rh, rat = _lists(batch, "h")
        buckets = np.array(batch.column("bucket").to_pylist(), object)
        for bucket in {*buckets} & {*x.bucket}:
            k = x.bucket[bucket]
            start, end = x.starts[k], x.ends[k]
            like = np.flatnonzero(buckets == bucket)
            lo = start + np.searchsorted(x.n[start:end], t * rn[like] - 1e-9)
            hi = start + np.searchsorted(x.place[start:end], rplace[like])
            like, lo, hi = (v[lo < hi] for v in (like, lo, hi))
            out = _left_out(part * (rn[like] + np.maximum(x.n[lo], t * rn[like])), rn[like])
            least = np.ceil(np.minimum(1 + x.n[lo] // _SPARE, part * (rn[like] + x.n[lo])) - 1e-9).astype(np.int64)
            a, b = [], []
            for row, i, j, o, m in zip(like.tolist(), lo.tolist(), hi.tolist(), out.tolist(), least.tolist()):
                own = rh[rat[row] : rat[row + 1]]
                counts = x.counts(k, own[: len(own) - o], j)
                if counts is None:
                    continue
                found = i + np.flatnonzero(counts[i:j] >= m)
                found = found[counts[found] >= part * (rn[row] + x.n[found]) - np.maximum(o, x.out[found]) - 1e-9]
                if not len(found):
                    continue
                marks[own] = True
                tokens, size = _tokens(x.h, x.at, found)
                shares = np.add.reduceat(marks[tokens], np.cumsum(size) - size, dtype=np.int64)
                marks[own] = False
                found = found[shares >= part * (size + rn[row]) - 1e-9]
                a.append(x.ids[found])
                b.append(np.full(len(found), rid[row]))
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(a), pa.string()), pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["bucket", "a", "b"])


def jaccard_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (bucket, a, b, sim), a < b, of ``rows`` (bucket, id, tokens) with Jaccard >= threshold > 0.

    Equal sets are compared once; their pairs are written out in the end. Two
    empty sets have similarity 1: each is paired with the bucket's first.
    """
    members, sets, hashed = fold_sets(rows)
    members = table_of(members)
    copies = members.where("n > 0")
    x, y = copies.select("bucket", "rep", F.col("id").alias("a")), copies.select("bucket", "rep", F.col("id").alias("b"))
    equal = x.join(y, ["bucket", "rep"]).where("a < b").select("bucket", "a", "b", F.lit(1.0).alias("sim"))
    found = set_pairs(sets, threshold, hashed).withColumnsRenamed({"a": "ra", "b": "rb"})
    left, right = members.select("bucket", F.col("rep").alias("ra"), F.col("id").alias("p")), members.select("bucket", F.col("rep").alias("rb"), F.col("id").alias("q"))
    spread = found.join(left, ["bucket", "ra"]).join(right, ["bucket", "rb"]).select(
        "bucket", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "sim"
    )
    empties = members.where("n = 0 and id <> rep").select("bucket", F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    return spread.union(equal).union(empties)


def jaccard_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id, rep, n_links) of each row: the least id with an equal set, and how many other rows reach the threshold."""
    members, sets, hashed = fold_sets(rows)
    members = table_of(members)
    found = set_pairs(sets, threshold, hashed).select("bucket", "a", "b")
    weight = members.groupBy("bucket", "rep").agg(F.count("*").alias("n"))
    ends = table_of(found.union(found.select("bucket", F.col("b"), F.col("a"))))
    others = ends.join(weight.select("bucket", F.col("rep").alias("b"), "n"), ["bucket", "b"]).groupBy("bucket", F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    links = weight.join(others, ["bucket", "rep"], "left").select("bucket", "rep", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(links, ["bucket", "rep"]).select("bucket", "id", "rep", "n_links")


def _close(table: pa.Table, threshold: float) -> pa.Table:
    """Pairs of two blocks that reach the threshold."""
    ids, lone = table.column("id").to_numpy(), table.column("low")[0] == table.column("high")[0]
    a, b, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for i, j, products in block_products(table):
        r, c = np.nonzero(products >= threshold)
        once = ids[i[r]] < ids[j[c]] if lone else ids[i[r]] != ids[j[c]]
        r, c = r[once], c[once]
        a, b, sim = np.minimum(ids[i[r]], ids[j[c]]), np.maximum(ids[i[r]], ids[j[c]]), products[r, c]
    bucket = pa.array([table.column("bucket")[0].as_py()] * len(a), pa.string())
    return pa.table({"bucket": bucket, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64())})


def cosine_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (bucket, a, b, sim), a < b, of normalised vectors (bucket, id, vec) with cosine >= threshold.

    Exact within a bucket; buckets are the L1 groups a library clusters in. A
    bucket is compared in blocks, so no task holds more than two of them.
    """
    own = rows.select(F.col("bucket").cast("string").alias("bucket"), "id", "vec").where(F.size("vec") > 0)
    return by_block_pair(own, "bucket", _arrow(partial(_close, threshold=threshold)), "bucket string, a bigint, b bigint, sim double")


def _arrow(f):
    """A function of exactly one argument, as grouped maps ask for."""

    def run(table: pa.Table) -> pa.Table:
        return f(table)

    return run


def _best_own(table: pa.Table) -> pa.Table:
    """Each vector's best similarity to another vector of two blocks."""
    ids = table.column("id").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))]
    for i, j, products in block_products(table):
        products = np.where(ids[i][:, None] == ids[j][None, :], -np.inf, products)
        out += [(ids[i], products.max(axis=1)), (ids[j], products.max(axis=0))]
    found, best = (np.concatenate(x) for x in zip(*out))
    seen = best > -np.inf
    return pa.table({"id": pa.array(found[seen], pa.int64()), "best": pa.array(best[seen], pa.float64())})


def nearest_member(rows: DataFrame) -> DataFrame:
    """(id, group_key, nearest): each vector's best similarity to another of its group, null for a lone one."""
    best = by_block_pair(rows.select("group_key", "id", "vec").where(F.size("vec") > 0), "group_key", _best_own, "id bigint, best double")
    nearest = best.groupBy("id").agg(F.max("best").alias("nearest"))
    return rows.select("id", "group_key").join(nearest, "id", "left")


def _best_by_group(table: pa.Table) -> pa.Table:
    """Best similarity of each asking vector of one block to each group of the other block."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    x = np.array(table.column("vec").to_pylist(), np.float64)
    i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
    groups, group = np.unique(np.array(table.column("group_key").to_pylist(), object)[j], return_inverse=True)
    ids, own = table.column("id").to_numpy()[i], np.array(table.column("group_key").to_pylist(), object)[i]
    best = np.full((len(i), len(groups)), -np.inf)
    if len(i) and len(j):
        products = x[i] @ x[j].T
        for g in range(len(groups)):
            best[:, g] = products[:, group == g].max(axis=1)
    r, g = np.nonzero(np.isfinite(best) & (own[:, None] != groups[None, :].astype(object)))
    return pa.table({
        "id": pa.array(ids[r], pa.int64()), "group_key": pa.array(own[r], pa.string()), "other_group": pa.array(groups[g], pa.string()),
        "sim": pa.array(best[r, g], pa.float64()),
    })


def best_by_group(asking: DataFrame, rows: DataFrame, size: int = 1024) -> DataFrame:
    """(id, group_key, other_group, sim): each asking vector's best similarity to every other group of ``rows``.

    Both sides (id, group_key, vec) are cut into blocks; a task holds one block of each.
    """
    def cut_up(df: DataFrame, asks: bool) -> tuple[DataFrame, int]:
        own = df.select("id", "group_key", "vec", F.size("vec").alias("_dims"), F.lit(asks).alias("asks")).where("_dims > 0")
        return own, max(1, -(-own.count() // size))

    (a, na), (b, nb) = cut_up(asking, True), cut_up(rows, False)
    a = a.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(na))).withColumn("_b", F.explode(F.expr(f"sequence(0L, {nb - 1}L)")))
    b = b.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("_a", F.explode(F.expr(f"sequence(0L, {na - 1}L)")))
    met = a.unionByName(b).groupBy("_dims", "_a", "_b").applyInArrow(_best_by_group, "id bigint, group_key string, other_group string, sim double")
    return met.groupBy("id", "group_key", "other_group").agg(F.max("sim").alias("sim"))


def outliers(rows: DataFrame, group_key: str | None = None, threshold: float = VISUAL_THRESHOLD) -> DataFrame:
    """Members of a group (of every group without one) whose best similarity to other members is under the threshold.

    ``rows`` (id, group_key, vec) are of one source. Each outlier comes with
    the other group that has its most similar vector, if that is over 0. Least
    similar first.
    """
    own = rows if group_key is None else rows.where(F.col("group_key") == group_key)
    near = table_of(nearest_member(own).where(F.col("nearest") < threshold).select("id", "group_key", "nearest"))
    asking = rows.join(near.select("id"), "id", "left_semi")
    best = best_by_group(asking, rows).where("sim > 0").groupBy("id").agg(F.max(F.struct("sim", "other_group")).alias("m")).select(
        "id", F.col("m.other_group").alias("best_group"), F.col("m.sim").alias("best_sim")
    )
    return near.join(best, "id", "left").orderBy(F.asc("nearest"), F.asc("id"))


def suggest_groups(selected: DataFrame, members: DataFrame) -> DataFrame:
    """Other groups ranked for the selected vectors of each group: mean over those of the best similarity to a member.

    selected and members (group_key, id, vec); rows (group_key, other_group, score, count).
    """
    best = best_by_group(selected, members)
    sizes = members.groupBy(F.col("group_key").alias("other_group")).agg(F.count("*").alias("count"))
    return best.groupBy("group_key", "other_group").agg(F.avg("sim").alias("score")).join(sizes, "other_group").select(
        "group_key", "other_group", "score", "count"
    ).orderBy("group_key", F.desc("score"), F.desc("count"), "other_group")


def folded_tokens(rows: DataFrame, key: list[str], kept: DataFrame) -> DataFrame:
    """Rows (group_key, ..., w) as (group_key, size, tokens, n): the size of the whole set, its tokens among those ``kept`` (token), and how many rows are so."""
    each = rows.select(*key, F.size("w").alias("size"), F.explode("w").alias("token")).join(kept, "token").groupBy(*key, "size").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return each.groupBy("group_key", "size", "tokens").agg(F.count("*").alias("n"))


def suggest_by_tokens(selected: DataFrame, members: DataFrame) -> DataFrame:
    """The same by token sets (group_key, id, tokens), where there are no vectors: the mean of the best Jaccard similarity.

    Only rows that share a token meet; a group none of whose members shares one counts as 0. Tokens that no
    other group has, or that are not asked for, only count in a set's size, so rows of a group alike but
    for those are one row.
    """
    s = selected.select("group_key", F.col("id").alias("sid"), F.array_distinct("tokens").alias("w")).distinct()
    m = members.select("group_key", F.array_distinct("tokens").alias("w"))
    there = m.select("group_key", F.explode("w").alias("token")).distinct().groupBy("token").agg(F.min("group_key").alias("low"), F.max("group_key").alias("high"))
    asked_for = s.select("group_key", F.explode("w").alias("token")).distinct().groupBy("token").agg(F.min("group_key").alias("least"), F.max("group_key").alias("most"))
    alone = (F.col("low") == F.col("high")) & (F.col("least") == F.col("most")) & (F.col("low") == F.col("least"))
    met = table_of(there.join(asked_for, "token").where(~alone).select("token"))

    left = table_of(folded_tokens(s, ["group_key", "sid"], met).withColumn("set", F.struct("size", "tokens")))
    right = table_of(folded_tokens(m.withColumn("mid", F.sha2(F.to_json(F.struct("w")), 256)).distinct(), ["group_key", "mid"], met).withColumnRenamed("group_key", "other_group").withColumn("other", F.struct("size", "tokens")))
    x = left.select("group_key", "n", "set", F.explode("tokens").alias("token"))
    y = right.select("other_group", "other", F.explode("tokens").alias("token"))
    shared = x.join(y, "token").where("group_key <> other_group").groupBy("group_key", "n", "set", "other_group", "other").agg(F.count("*").alias("both"))
    sim = F.col("both") / (F.col("set.size") + F.col("other.size") - F.col("both"))
    best = shared.withColumn("sim", sim).groupBy("group_key", "n", "set", "other_group").agg(F.max("sim").alias("sim"))
    asked = selected.groupBy("group_key").agg(F.count_distinct("id").alias("asked"))
    sizes = members.groupBy(F.col("group_key").alias("other_group")).agg(F.count("*").alias("count"))
    return best.groupBy("group_key", "other_group").agg(F.sum(F.col("sim") * F.col("n")).alias("total")).join(asked, "group_key").join(sizes, "other_group").select(
        "group_key", "other_group", (F.col("total") / F.col("asked")).alias("score"), "count"
    ).orderBy("group_key", F.desc("score"), F.desc("count"), "other_group")

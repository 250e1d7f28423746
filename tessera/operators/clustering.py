"""Prompt and vector clustering within L1 buckets, manual bindings, and cluster keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.constants import JACCARD_THRESHOLD, SEMANTIC_THRESHOLD, SLOTS, VISUAL_THRESHOLD
from tessera.functions.keys import manual_key, prompt_hash, text_cluster_key, vector_cluster_key
from tessera.functions.text import token_set
from tessera.operators.blocks import against_chunks, matrix, placed_table
from tessera.operators.components import components
from tessera.operators.similarity import _arrow, fold_sets, set_pairs
from tessera.store import table_of

DEFAULT_THRESHOLDS = {"text": JACCARD_THRESHOLD, "visual": VISUAL_THRESHOLD, "semantic": SEMANTIC_THRESHOLD}


def single_linkage(rows: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id, cluster) of ``rows`` (bucket, id, tokens): components of Jaccard >= threshold; a cluster is its least id.

    Equal sets are one node. At a threshold of 0 or less every bucket is one cluster.
    """
    if threshold <= 0:
        least = rows.groupBy("bucket").agg(F.min("id").alias("cluster"))
        return rows.select("bucket", "id").join(least, "bucket")
    members, sets, hashed = fold_sets(rows)
    linked = components(set_pairs(sets, threshold, hashed).select("a", "b"))
    found = members.join(linked, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("cluster"))
    return rows.select("bucket", "id").join(found, "id", "left").select("bucket", "id", F.coalesce("cluster", "id").alias("cluster"))


#: Means are compared as whole numbers of 1 / SCALE, so that equal ones tie whatever order they were summed in.
SCALE = 2**32
#: A mean counts as at the threshold from so much below it, for rounding.
SLACK = 1e-9


#: Clusters of a bucket that one task merges.
FITS = 2**14
#: Rows and columns of the products that a task holds at a time, and pairs whose means it rounds at a time.
TILE, EXACT = (512, 8192), 2**16
#: Slabs of rows that are sent out at a time.
SENT = 64


def average_linkage(rows: DataFrame, threshold: float, fits: int = FITS) -> DataFrame:
    """(bucket, id, cluster) of normalised vectors (bucket, id, vec); a cluster is its least id.

    Average linkage: the two clusters of a bucket with the highest mean
    pairwise similarity merge while that is >= threshold. Two clusters that
    prefer each other merge in any order with the same result, so each round
    merges all such pairs at once. The mean similarity of two clusters is the product
    of their mean vectors, so a cluster is its size and sum and no pair is ever stored; one
    whose best mean is under the threshold is done, as a merge never raises a mean. Equal
    vectors are one weighted row from the start (their mean is 1, which a
    threshold over 1 would not reach). Ties go to the least ids. A bucket of up to ``fits``
    clusters is merged by one task; a larger one in rounds over all tasks until it is one of those.
    """
    if threshold > 1:
        return rows.select("bucket", "id", F.col("id").alias("cluster"))
    own = rows.select(F.col("bucket").cast("string").alias("bucket"), "id", "vec").withColumn("_h1", F.xxhash64("vec")).withColumn("_h2", F.xxhash64(F.lit(1), "vec"))
    equal = ["bucket", "_h1", "_h2"]
    reps = table_of(own.groupBy(*equal).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("vec").alias("vec")))
    inside = reps.where(F.size("vec") > 0).select(  # vectors of different lengths never meet
        F.concat_ws(" ", F.size("vec"), "bucket").alias("bucket"), F.col("rep").alias("id"), "n", F.transform("vec", lambda x: x.cast("double") * F.col("n")).alias("vec")
    )
    merged, left = _merged_in_rounds(inside, threshold, fits)
    last = left.groupBy("bucket").applyInArrow(_arrow(partial(_merged, threshold=threshold)), "id bigint, into bigint").where("id <> into")
    cluster = _moved(_moved(reps.select("rep", F.col("rep").alias("cluster")), merged), table_of(last))
    found = own.select("bucket", "id", "_h1", "_h2").join(reps.select(*equal, "rep"), equal).join(cluster, "rep")
    return found.select("bucket", "id", "cluster")


def _moved(cluster: DataFrame, merged: DataFrame | None) -> DataFrame:
    """(rep, cluster) after the merges (id, into)."""
    if merged is None:
        return cluster
    return cluster.join(merged, F.col("cluster") == F.col("id"), "left").select("rep", F.coalesce("into", "cluster").alias("cluster"))


def _best_partners(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each mean vector of ``x`` the best product with another of ``y`` in units of 1 / SCALE, and whose it is (the least of equal ones); -inf for none >= threshold.

    ``others`` ascend. A pair has the same value on both sides: products in tiles only say which pairs are near the best, these are summed alike.
    """
    best, partner = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
    for i in range(0, len(ids), TILE[0]):
        for j in range(0, len(others), TILE[1]):
            mine, theirs = ids[i : i + TILE[0]], others[j : j + TILE[1]]
            products = x[i : i + TILE[0]] @ y[j : j + TILE[1]].T
            at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            itself = np.flatnonzero(theirs[at] == mine)
            products[itself, at[itself]] = -np.inf
            least = np.maximum(np.maximum(products.max(axis=1), threshold - SLACK), best[i : i + TILE[0]] / SCALE) - 4 / SCALE
            r, c = np.nonzero(products >= least[:, None])
            for k in range(0, len(r), EXACT):
                rows, columns = r[k : k + EXACT], c[k : k + EXACT]
                value = np.rint((x[i + rows] * y[j + columns]).sum(axis=1) * SCALE)
                order = np.lexsort((theirs[columns], -value, rows))
                order = order[np.r_[True, np.diff(rows[order]) > 0]]
                rows, value, whose = i + rows[order], value[order], theirs[columns[order]]
                better = (value >= (threshold - SLACK) * SCALE) & ((value > best[rows]) | ((value == best[rows]) & (whose < partner[rows])))
                best[rows[better]], partner[rows[better]] = value[better], whose[better]
    return best, partner


def _merged(table: pa.Table, threshold: float) -> pa.Table:
    """What each cluster of a bucket that fits a task ends in, in rounds of mutually best pairs; a best partner is looked for again once either side has merged."""
    table = table.sort_by("id")
    ids, n, total = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.float64), matrix(table)
    into = np.arange(len(ids))  # rows stand for ids, both ascend
    left = ask = into.copy()
    best, partner = np.full(len(ids), -np.inf), into.copy()
    while len(left):
        mean = total[left] / n[left, None]
        best[ask], partner[ask] = _best_partners(ask, mean[np.searchsorted(left, ask)], left, mean, threshold)
        whole, left = len(ask) == len(left), left[best[left] > -np.inf]
        a = left[(partner[partner[left]] == left) & (left < partner[left])]
        if not len(a):
            if whole:
                break
            ask = left  # rounding let a merge raise a mean: look at all again
            continue
        b = partner[a]
        total[a] += total[b]
        n[a] += n[b]
        step, new = np.arange(len(ids)), np.zeros(len(ids), bool)
        step[b], new[a], new[b] = a, True, True
        into = step[into]
        left = np.setdiff1d(left, b)
        ask = left[new[left] | new[partner[left]]]
    return pa.table({"id": pa.array(ids, pa.int64()), "into": pa.array(ids[into], pa.int64())})


def _means(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("id").to_numpy(), matrix(table) / table.column("n").to_numpy().astype(np.float64)[:, None]


def _met(batches: Iterator[pa.RecordBatch], shared: Broadcast, threshold: float) -> Iterator[pa.RecordBatch]:
    """The best partner of each cluster among those of its bucket in a chunk."""
    chunk = shared.value
    sides = {b: _means(chunk.filter(pc.equal(chunk.column("bucket"), b))) for b in chunk.column("bucket").unique().to_pylist()}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for b in table.column("bucket").unique().to_pylist():
            ids, x = _means(table.filter(pc.equal(table.column("bucket"), b)))
            best, partner = _best_partners(ids, x, *sides[b], threshold)
            seen = best > -np.inf
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[seen], pa.int64()), "best": pa.array(best[seen], pa.float64()), "partner": pa.array(partner[seen], pa.int64())})


def _merged_in_rounds(inside: DataFrame, threshold: float, fits: int) -> tuple[DataFrame | None, DataFrame]:
    """The merges (id, into) in buckets too large for a task, and the clusters (bucket, id, n, vec) that then fit.

    A round sends the clusters out in chunks; those of the same buckets stream past and keep their best partner. Only that is written, and the new sums.
    """
    columns = ["bucket", "id", "n", "vec"]
    sized = lambda df, large: df.groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") > fits if large else F.col("k") <= fits).select("bucket")
    small, large = inside.join(sized(inside, False), "bucket", "left_semi").select(*columns), inside.join(sized(inside, True), "bucket", "left_semi")
    if large.isEmpty():
        return None, small
    now = placed_table(large.select(*columns), [F.asc("bucket"), F.asc("id")])
    parts = now.rdd.getNumPartitions()
    cluster, left = None, small
    while not now.isEmpty():
        met = against_chunks(now, 2 * F.size("vec"), partial(_met, threshold=threshold), "id bigint, best double, partner bigint", slabs=SENT, same="bucket")
        best = table_of(met.groupBy("id").agg(F.max_by("partner", F.struct("best", -F.col("partner"))).alias("partner")))
        other = best.select(F.col("id").alias("partner"), F.col("partner").alias("back"))
        merged = table_of(best.join(other, "partner").where("back = id and partner < id").select("id", F.col("partner").alias("into")))
        cluster = merged if cluster is None else table_of(_moved(cluster.withColumnsRenamed({"id": "rep", "into": "cluster"}), merged).withColumnsRenamed({"rep": "id", "cluster": "into"}).union(merged))
        going = now.join(best.select("id"), "id", "left_semi")
        gone = going.join(merged, "id").select(F.col("into").alias("id"), F.col("n").alias("_n"), F.col("vec").alias("_vec"))
        new = going.join(merged.select("id"), "id", "left_anti").join(gone, "id", "left").select(
            "bucket", "id", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            F.when(F.col("_vec").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_vec", lambda x, y: x + y)).alias("vec"), "position",
        )
        new = table_of(new)
        left = left.union(new.join(sized(new, False), "bucket", "left_semi").select(*columns))
        now = table_of(new.join(sized(new, True), "bucket", "left_semi").repartition(parts, "position").sortWithinPartitions("position"))
    return cluster, left


def with_bindings(keyed: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, group_key): a level-2 binding comes before the computed key."""
    bound = bindings.where(F.col("level") == 2).select(F.col("image_id").alias("id"), F.col("group_key").alias("bound"))
    return keyed.join(bound, "id", "left").select("id", F.coalesce("bound", "group_key").alias("group_key"))


def recluster_text(images: DataFrame, bindings: DataFrame, threshold: float = JACCARD_THRESHOLD, only_l1: list[str] | None = None, policy: str = "md5") -> DataFrame:
    """New level-2 keys (id, group_key) from prompt similarity within L1 buckets."""
    rows = images if only_l1 is None else images.where(F.col("group_key_l1").isin(only_l1))
    tokens = rows.select(F.col("group_key_l1").alias("bucket"), "id", token_set(F.col("prompt_pos")).alias("tokens"))
    clusters = single_linkage(tokens, threshold)
    hashed = rows.select("id", prompt_hash(F.col("prompt_pos"), policy).alias("h"))
    keys = clusters.join(hashed, "id").groupBy("bucket", "cluster").agg(F.collect_set("h").alias("hashes")).select(
        "bucket", "cluster", text_cluster_key(F.col("bucket"), F.col("hashes"), policy).alias("group_key")
    )
    return with_bindings(clusters.join(keys, ["bucket", "cluster"]).select("id", "group_key"), bindings)


def recluster_vectors(images: DataFrame, signatures: DataFrame, bindings: DataFrame, threshold: float, policy: str = "md5") -> DataFrame:
    """New level-2 keys (id, group_key) of the images that have a vector; others keep theirs."""
    vectors = signatures.select(F.col("image_id").alias("id"), "vec")
    rows = images.select("id", F.col("group_key_l1").alias("bucket")).join(vectors, "id")
    clusters = average_linkage(rows, threshold)
    keyed = clusters.select("id", vector_cluster_key(F.col("bucket"), F.col("cluster"), policy).alias("group_key"))
    return with_bindings(keyed, bindings)


def recluster(images: DataFrame, signatures: DataFrame, bindings: DataFrame, mode: str = "text", threshold: float | None = None, policy: str = "md5") -> DataFrame:
    """Recluster in the source's mode: text, visual or semantic. Slot and model always go together."""
    at = DEFAULT_THRESHOLDS[mode] if threshold is None else threshold
    if mode == "text":
        return recluster_text(images, bindings, at, policy=policy)
    slot, model = SLOTS[mode]
    own = signatures.where((F.col("slot") == slot) & (F.col("model_id") == model))
    return recluster_vectors(images, own, bindings, at, policy)


def merge_groups(images: DataFrame, keys: list[str], policy: str = "md5", source_id: int | None = None, level: int = 2) -> DataFrame:
    """Bindings that put all members of the groups under one manual key, with the keys they had.

    Only groups of level 2 can be merged; with ``source_id`` those of that source, which must be given where sources share a key.
    """
    if level != 2:
        raise ValueError("only groups of level 2 can be merged")
    rows = images.where(F.col("group_key_l2").isin(keys))
    if source_id is not None:
        rows = rows.where(F.col("source_id") == source_id)
    key = rows.agg(manual_key(F.collect_set(prompt_hash(F.col("prompt_pos"), policy)), policy).alias("group_key"))
    return _bound(rows, "merge").join(key)


def split_images(images: DataFrame, ids: list[int], policy: str = "md5") -> DataFrame:
    """Bindings that put the images under a manual key of their own."""
    rows = images.where(F.col("id").isin(ids))
    key = rows.agg(manual_key(F.collect_set(prompt_hash(F.col("prompt_pos"), policy)), policy).alias("group_key"))
    return _bound(rows, "split").join(key)


def move_images(images: DataFrame, ids: list[int], target: str) -> DataFrame:
    """Bindings that put the images in an existing group."""
    return _bound(images.where(F.col("id").isin(ids)), "move").withColumn("group_key", F.lit(target))


def _bound(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(F.lit(2).alias("level"), F.col("id").alias("image_id"), F.lit(kind).alias("kind"), F.col("group_key_l2").alias("prev_group_key"))


def unbind(images: DataFrame, bindings: DataFrame, key: str, kind: str, source_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Undo a merge or split: (restored level-2 keys (id, group_key), bindings that stay). Moves cannot be undone so."""
    if kind not in ("merge", "split"):
        raise ValueError("only merges and splits are undone")
    mine = bindings.where((F.col("level") == 2) & (F.col("group_key") == key) & (F.col("kind") == kind))
    if source_id is not None:
        inside = images.where(F.col("source_id") == source_id).select(F.col("id").alias("image_id"))
        mine = mine.join(inside, "image_id", "left_semi")
    restored = mine.where(F.col("prev_group_key").isNotNull()).select(F.col("image_id").alias("id"), F.col("prev_group_key").alias("group_key"))
    return restored, bindings.join(mine.select("level", "image_id"), ["level", "image_id"], "left_anti")

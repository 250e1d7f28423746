"""Ranked lexical search by a threshold-seeded join (operator 11).

The index holds, per document, the items' terms it contains with their counts,
and per term its weight, its best impact and its ``k``-th best impact. As ``k``
documents reach a term's k-th impact, weight times that impact is a lower bound
of the k-th score of every item that has the term; the best of an item's terms
seeds its threshold. An item's terms are put in falling order of their best
possible part. A posting makes its document a candidate only if its own part
and the bounds of all terms after it (the suffix bound) reach the threshold; a
term whose suffix bound is below the threshold is not looked up at all. Nothing
is lost: the first posting of a document that reaches the threshold passes.
Candidates are rescored exactly over all terms of the item, and a task's own
k-th exact score raises the threshold for what it has still to read.

Items are taken in blocks of a bounded number of terms, each against all
documents, so what is broadcast is bounded by ``block_terms``.

Nulls and edges: a null or empty text has no terms and is neither counted nor
found. Each row is a document; rows that repeat a doc_id rank beside each
other. Rows with a null doc_id count in the statistics and are not ranked. Rows
of one item_id are one item; those with a null item_id are left out. Equal
scores rank by doc_id. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_bytes

#: The contract's characters outside terms; all others make terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANKED = "item_id {item}, rank int, doc_id long, score long"


@dataclass(frozen=True)
class Search:
    """``k`` documents an item; a pass takes items with about ``block_terms`` terms."""

    k: int = 50
    block_terms: int = 200_000
    cells: int = 4_000_000


@dataclass
class Plan:
    """A block's items by term: weights, suffix bounds, thresholds. Entries of one term lie together, the essential ones first."""

    start: np.ndarray
    essential: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    after: np.ndarray
    bound: np.ndarray
    docs: int
    terms: int
    k: int
    cells: int


def terms_of(text: Column) -> Column:
    """Terms of a text: A-Z lower-cased, in order, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def impact(tf: Column, n: Column, docs: int, terms: int) -> Column:
    """Part of a term in a document's score before its weight, in whole numbers."""
    m = F.lit(50) + F.call_function("div", F.lit(50) * n * F.lit(docs), F.lit(terms))
    return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(20) * m)


def _forward(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value
    for batch in batches:
        ids, lengths, ends, terms, tfs = [], [], [0], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = _TERM_BYTES.findall(text.lower())
            if not found:
                continue
            for term, tf in Counter(found).items():
                at = known.get(term)
                if at is not None:
                    terms.append(at)
                    tfs.append(tf)
            ids.append(doc_id)
            lengths.append(len(found))
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
            ],
            names=["doc_id", "n", "terms", "tfs"],
        )


def term_statistics(index: DataFrame, docs: int, terms: int, k: int) -> DataFrame:
    """(term, df, best, kth): documents with the term, its best impact and its k-th best one (0 if fewer documents rank)."""
    postings = index.select("doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        F.col("p.terms").alias("term"), impact(F.col("p.tfs"), F.col("n"), docs, terms).alias("impact"), "doc_id"
    )
    place = F.row_number().over(W.partitionBy("term").orderBy(F.desc("impact")))
    ranked = postings.where("doc_id is not null").select("term", "impact").withColumn("place", place).where(F.col("place") <= k)
    seeds = ranked.groupBy("term").agg(F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))
    return postings.groupBy("term").agg(F.count("*").alias("df")).join(seeds, "term")


def _plan(pairs: list[tuple[int, int]], items: int, statistics: dict[int, tuple[int, int, int]], size: int, docs: int, terms: int, p: Search) -> Plan:
    """Thresholds from k-th impacts, and every item's terms in falling order of their bounds with the suffix bound after each."""
    weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for t, (df, _, _) in statistics.items()}
    by_item: list[list[int]] = [[] for _ in range(items)]
    for item, term in pairs:
        if term in weight:
            by_item[item].append(term)
    rows, bound = [], np.ones(items, np.int64)
    for item, own in enumerate(by_item):
        bound[item] = max([1, *(weight[t] * statistics[t][2] for t in own)])
        after = 0
        for t in sorted(own, key=lambda t: (weight[t] * statistics[t][1], t)):
            own_most = weight[t] * statistics[t][1]
            rows.append((t, own_most + after < bound[item], item, weight[t], after))
            after += own_most
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    start = np.searchsorted(table[:, 0], np.arange(size + 1))
    essential = start[:-1] + np.bincount(table[table[:, 1] == 0, 0], minlength=size)
    return Plan(start, essential, table[:, 2].copy(), table[:, 3].copy(), table[:, 4].copy(), bound, docs, terms, p.k, p.cells)


def _entries(low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(posting, entry) of all entries low..high of each posting, about ``most`` at a time."""
    width = high - low
    ends = np.cumsum(width)
    at = 0
    while at < len(width):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        w = width[at:to]
        posting = np.repeat(np.arange(at, to), w)
        yield posting, np.arange(len(posting)) - np.repeat(ends[at:to] - w - before, w) + np.repeat(low[at:to], w)
        at = to


class _Thresholds:
    """The thresholds of a task: the seeds, raised by the k-th best exact score it has seen itself."""

    def __init__(self, plan: Plan) -> None:
        self.bound, self.k, self.best = plan.bound.copy(), plan.k, {}

    def see(self, items: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(items, kind="stable")
        cuts = np.flatnonzero(np.diff(items[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            item = int(items[own[0]])
            kept = np.concatenate([self.best.get(item, np.empty(0, np.int64)), scores[own]])
            if len(kept) >= self.k:
                kept = np.partition(kept, len(kept) - self.k)[-self.k :]
                self.bound[item] = max(self.bound[item], kept.min())
            self.best[item] = kept


def _ranked(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    plan: Plan = shared.value
    seen, items = _Thresholds(plan), len(plan.bound)
    step = max(1, plan.cells // max(1, items))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            n = batch.column("n").to_numpy()
            terms = batch.column("terms").flatten().to_numpy()
            tf = batch.column("tfs").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("terms").offsets.to_numpy()))
            parts = (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * plan.docs) // plan.terms)[row])
            wanted = np.zeros(batch.num_rows * items, bool)
            for posting, entry in _entries(plan.start[terms], plan.essential[terms], plan.cells // 2):
                item = plan.item[entry]
                reach = plan.weight[entry] * parts[posting] + plan.after[entry] >= seen.bound[item]
                wanted[(row[posting] * items + item)[reach]] = True
            hit = wanted.reshape(batch.num_rows, items).any(axis=1)[row]
            terms, parts, row = terms[hit], parts[hit], row[hit]
            score = np.zeros(len(wanted), np.int64)
            for posting, entry in _entries(plan.start[terms], plan.start[terms + 1], plan.cells // 2):
                cell = row[posting] * items + plan.item[entry]
                chosen = wanted[cell]
                np.add.at(score, cell[chosen], (plan.weight[entry] * parts[posting])[chosen])
            cell = np.flatnonzero(score)
            value, item = score[cell], cell % items
            enough = value >= seen.bound[item]
            cell, value, item = cell[enough], value[enough], item[enough]
            seen.see(item, value)
            enough = value >= seen.bound[item]
            ids = batch.column("doc_id").take(pa.array(cell[enough] // items))
            yield pa.RecordBatch.from_arrays([pa.array(item[enough].astype(np.int32)), ids, pa.array(value[enough])], names=["item", "doc_id", "score"])


def _block(docs: DataFrame, pairs: list, p: Search) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of the items of ``pairs`` (item_id, term), of a bounded number of terms."""
    spark = docs.sparkSession
    names = sorted({r[0] for r in pairs})
    words = sorted({r[1] for r in pairs})
    item_at, term_at = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast({w.encode(): i for w, i in term_at.items()})
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    index = cut(source.mapInArrow(partial(_forward, vocabulary=vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "index")
    size = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not size["docs"]:
        return None
    statistics = {r["term"]: (r["df"], r["best"], r["kth"]) for r in term_statistics(index, size["docs"], size["terms"], p.k).collect()}
    plan = _plan([(item_at[i], term_at[t]) for i, t in pairs], len(names), statistics, len(words), size["docs"], size["terms"], p)
    shared = spark.sparkContext.broadcast(plan)
    found = index.where("doc_id is not null").mapInArrow(partial(_ranked, shared=shared), "item int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= p.k)
    item_id = F.get(F.lit(names), F.col("item"))
    return cut(best.select(item_id.alias("item_id"), "rank", "doc_id", "score"), "ranked")


def search(docs: DataFrame, items: DataFrame, p: Search = Search()) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score."""
    pairs = cut(
        items.where("item_id is not null").select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct(), "item-terms"
    )
    blocks = math.ceil(1.5 * pairs.count() / p.block_terms)
    done = []
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_terms rows at most
        found = _block(docs, [tuple(r) for r in own], p) if own else None
        done += [found] if found is not None else []
    if not done:
        return docs.sparkSession.createDataFrame([], RANKED.format(item=items.schema["item_id"].dataType.simpleString()))
    return reduce(DataFrame.union, done)


ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS t FROM documents),
size AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY row_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY 1), size),
s AS (SELECT item_id, row_id, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term), size WHERE doc_id IS NOT NULL GROUP BY item_id, row_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

"""Best-fit packing of documents into token sequences (operator 10).

Bulk-synchronous best fit. Pieces and gaps (what sequences have left) are
sorted by size, longest first, and dealt into size ranges. In a superstep every
range is swept at once, on its own task: each piece takes its successor, the
smallest gap of the range that holds it; pieces that want the same gap are
resolved by rank (longer first, then by number within the length); gaps shrink
and fall into lower ranges. The next superstep has half as many ranges, so
that what found no gap in its range meets the larger ones; the last one sweeps
the whole and opens new sequences for what is left. Pieces over half the
capacity open their sequences before the first superstep.

Pieces of one length, and sequences with one gap, are alike, so the sorted
lists are run-length coded: ``capacity`` lengths at most, and a sweep leaves at
most two runs more than it takes for each length. The state of the sweeps is
therefore bounded by the capacity whatever the corpus is; pieces themselves
stay distributed, are ranked by a two-level count and look their place up by
(length, rank).

Nulls and edges: a null or empty text has the end token alone; a null doc_id
stays null; repeated rows are separate documents. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator
from contextlib import suppress
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, remembered
from tessera.operators.blocks import numbered

CAPACITY = 4096
END_ID = 1
SALTS = 64


class ChunkIds(dict):
    """Token ids of space-free chunks as packed little-endian uint32.

    The word vocabulary's tokenizer lower-cases and never joins text across
    white space, nor a letter with a stop or comma after it, so a text's ids
    are those of its chunks in turn. Texts in Latin-1 are lower-cased before
    they are looked up, where Python and the tokenizer agree on it. The first
    ``limit`` distinct chunks are remembered, others only while their texts
    are at hand.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.new: set[str] = set()

    def __missing__(self, chunk: str) -> None:
        self.new.add(chunk)

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each whole text."""
        split = [_lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        found = [list(map(self.__getitem__, chunks)) for chunks in split]
        passing = self._encoded()
        for chunks, ids in zip(split, found):
            at = -1
            with suppress(ValueError):  # no further gap
                while True:
                    at = ids.index(None, at + 1)
                    ids[at] = passing[chunks[at]]
            yield b"".join(ids)

    def _encoded(self) -> dict[str, bytes]:
        """Ids of the chunks that were missing."""
        cuts = {c: n for c in self.new if (n := _stop_at(c))}
        bases = {c[:n] for c, n in cuts.items()} | {c[n:] for c, n in cuts.items()}
        fresh = [c for c in (self.new - cuts.keys()) | bases if c not in self]
        found = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        passing = {c: array("I", e.ids).tobytes() for c, e in zip(fresh, found)}
        for c, n in cuts.items():
            base, stop = c[:n], c[n:]
            passing[c] = (passing.get(base) or self[base]) + (passing.get(stop) or self[stop])
        self.new = set()
        if len(self) < self.limit:
            self.update(passing)
        return passing


def _lowered(text: str) -> str:
    if "<|" in text:  # special tokens are written in lower case
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _stop_at(chunk: str) -> int:
    """Where the stops and commas after a chunk's last letter begin; 0 if there are none."""
    base = chunk.rstrip(".,")
    return len(base) if base and len(base) < len(chunk) and base[-1].isalpha() else 0


def token_bytes(texts: list[str], path: str, at_once: int = 256) -> Iterator[bytes]:
    """Ids of each whole text, packed."""
    for k in range(0, len(texts), at_once):
        yield from remembered(f"chunks {path}", partial(ChunkIds, path)).texts(texts[k : k + at_once])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        places: list = []
        own = batch.column("place").to_pylist() if "place" in batch.schema.names else [None] * batch.num_rows
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc_id, place, data in zip(batch.column("doc_id").to_pylist(), own, token_bytes(texts, path)):
            data += end
            for k, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                for column, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(v)
                places.append(place)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays, names = [pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        if "place" in batch.schema.names:
            arrays, names = [*arrays, pa.array(places, pa.int64())], [*names, "place"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, place: Column | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, and their document's ``place`` where one is given."""
    also = [] if place is None else [place.cast("long").alias("place")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also).mapInArrow(
        partial(_pieces, path=tokenizer_path, capacity=capacity, end_id=end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long" + (", place long" if also else ""),
    )


PIECES, GAPS, PLACED, OPENED = range(4)
#: Runs of the sweeps. PIECES: n unplaced pieces of length ``size`` from ``rank`` on. GAPS: n sequences from ``first`` on
#: with ``size`` left. PLACED: pieces of length ``size`` from ``rank`` on go to sequences from ``first`` on, ``each`` to
#: one, at ``offset``. OPENED: sequences up to ``first`` are in use.
RUNS = ["kind", "size", "rank", "n", "each", "first", "offset"]
_RUNS_DDL = ", ".join(f"{c} long" for c in RUNS)
Run = tuple[int, int, int, int, int, int, int]


def sweep(runs: list[Run], capacity: int, last: bool) -> list[Run]:
    """One superstep of a size range: best fit of its pieces, longest first, in its gaps.

    Pieces without a gap stay, or in the ``last`` superstep open sequences.
    """
    sizes: list[int] = []  # sorted sizes of the gaps there are
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs (first sequence, how many)
    out: list[Run] = []

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for r in sorted(runs, reverse=True):
        if r[0] == GAPS:
            put(r[1], r[5], r[3])
    used = max((r[5] for r in runs if r[0] == OPENED), default=0)
    for _, length, rank, left, *_ in sorted((r for r in runs if r[0] == PIECES), key=lambda r: (-r[1], r[2])):
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                size = sizes[k]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[k]
            elif last:
                size, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            else:
                out.append((PIECES, length, rank, left, 0, 0, 0))
                break
            each = size // length
            full, rest = divmod(left, each)
            take = min(n, full)
            if take:
                out.append((PLACED, length, rank, take * each, each, first, capacity - size))
                rank, left = rank + take * each, left - take * each
                put(size - each * length, first, take)
            if take < n and left:  # the last sequence gets the rest
                out.append((PLACED, length, rank, left, left, first + take, capacity - size))
                put(size - left * length, first + take, 1)
                left, take = 0, take + 1
            put(size, first + take, n - take)
    out += [(GAPS, size, 0, n, 0, first, 0) for size, found in gaps.items() for first, n in found]
    return out + [(OPENED, 0, 0, 0, 0, used, 0)] * any(r[0] == OPENED for r in runs)


def _swept(capacity: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sweep(list(map(tuple, rows[RUNS].to_numpy().tolist())), capacity, last), columns=RUNS, dtype="int64")

    return run


def best_fit(counts: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """PLACED runs for pieces counted by length (size, n): supersteps over 8, 4, 2 and 1 size ranges."""
    zero = F.lit(0).cast("long")
    alone = F.col("size") * 2 > capacity
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), zero)
    large = cut(counts.where(alone).withColumn("first", before), "large")  # at most capacity / 2 rows

    def shaped(df: DataFrame, **given) -> DataFrame:
        return df.select(*(given.get(c, F.col(c) if c in df.columns else zero).cast("long").alias(c) for c in RUNS))

    placed = [shaped(large, kind=F.lit(PLACED), each=F.lit(1))]
    state = shaped(large.where(F.col("size") < capacity), kind=F.lit(GAPS), size=F.lit(capacity) - F.col("size"))
    state = state.union(shaped(counts.where(~alone), kind=F.lit(PIECES)))
    state = state.union(shaped(large.agg(F.coalesce(F.max(F.col("first") + F.col("n")), zero).alias("first")), kind=F.lit(OPENED)))
    while ranges:
        band = F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) * ranges / capacity)
        state = cut(state.groupBy(band.alias("band")).applyInPandas(_swept(capacity, ranges == 1), _RUNS_DDL), "sweep")
        placed.append(state.where(F.col("kind") == PLACED))
        state = state.where(F.col("kind") != PLACED)
        ranges //= 2
    return reduce(DataFrame.union, placed)


def _placed(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] * 2**48 + plan[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        row = plan[np.searchsorted(keys, length * 2**48 + rank, side="right") - 1]
        within = rank - row[:, 1]
        names = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(row[:, 3] + within // row[:, 2]), pa.array(row[:, 4] + within % row[:, 2] * length)],
            names=[*names, "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, place: Column | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset there; with ``place`` sequences are numbered from 0 by the earliest place in each."""
    table = cut(pieces(docs, tokenizer_path, capacity, end_id, place), "pieces").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))
    )
    # rank of a piece among those of its length: its rank in a salted part, and what the parts before it hold
    parts = table.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = parts.withColumn(
        "before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    counts = table.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("n"))
    runs = best_fit(counts, capacity).select("size", "rank", "each", "first", "offset").toArrow()  # bounded by the capacity
    plan = np.stack([c.to_numpy() for c in runs.columns], axis=1) if runs.num_rows else np.zeros((0, 5), np.int64)
    within = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*([] if place is None else ["place"]), "doc_id", "piece", "ids_crc32")) - 1
    # at most capacity * SALTS rows
    ranked = table.withColumn("within", within).join(F.broadcast(before), ["length", "_salt"]).withColumn("rank", F.col("within") + F.col("before"))
    also = [] if place is None else ["place"]
    packed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *also, "rank").mapInArrow(
        partial(_placed, plan=plan), f"doc_id long, piece int, start long, length long, ids_crc32 long, {'place long, ' if also else ''}sequence_id long, offset long"
    )
    if place is None:
        return packed
    packed = cut(packed, "packed")
    firsts = numbered(packed.groupBy("sequence_id").agg(F.min("place").alias("first")), [F.asc("first"), F.asc("sequence_id")], "turn")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("turn") - 1).alias("sequence_id"), "offset"]
    return packed.join(firsts.select("sequence_id", "turn"), "sequence_id").select(*columns)

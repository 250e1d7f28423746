"""Prefix trie of conversations by an LCP-aware mergesort (operator 12).

A turn (role, text) is a cell of 24 bytes: 16 of its SHA-256 and its number of
words. A conversation is the sequence of its cells. Equal conversations are one
class from the start, with their number, least id and the hash of their ids.
Classes are dealt to tasks by range. A task sorts each batch it gets to a run
whose rows carry the length of the prefix shared with the row before (LCP); a
loser tree merges the runs and looks at cells only behind a shared prefix. The
merged stream, again with LCPs, drives a stack of the open path: nodes that the
next sequence leaves are finished and emitted.

Only nodes on a range's first or last path can go on in a neighbouring range.
They are emitted open; the open paths of 64 neighbouring ranges are joined in
the same stack, and so on until one range is left. What a task holds is its
range (about ``range_bytes``), what it hands on are two paths.

Limits: a conversation is one row, 24 bytes a turn, as a text is one row. The
ids that end at one node are hashed one after another, as SHA-256 must be; they
come in pieces of up to 65,536 ids that other tasks have written out.

Nulls and edges: rows with a null conv_id belong to no conversation and are
left out; a null role or text is empty; a null turn comes first. Turns of one
number are ordered by their SHA-256; rows that repeat are turns of their own.
Extra columns are ignored. An empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

CELL = 24
#: Ranges whose open paths are joined at once.
FAN = 64
_ROOT = bytes(16)
_OPEN = (
    "range int, ord long, done boolean, first boolean, depth long, key binary, parent binary, words long, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string"
)
_COLUMNS = [c.split()[0] for c in _OPEN.split(", ")]


# ------------------------------------------------------------------ sequences


def cell(role: Column, text: Column) -> Column:
    """A turn's cell in hex: 16 bytes of the SHA-256 of role and text, 8 of the number of words."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(words.cast("long")), 16, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's cells in the order of its turns."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), "turn", cell(F.col("role"), F.col("text")).alias("cell")).alias("t")
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["cell"])
    return turns.groupBy("conv_id").agg(F.unhex(F.concat_ws("", ordered)).alias("seq"))


def rebuilt(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, seq): the first h cells of conversation c - c % family, then c's own after its first h; h = crc32(c) % most."""
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {CELL * (most - 1)})").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    seq = F.concat(F.expr(f"coalesce(substring(head, 1, {CELL} * h), X'')"), F.expr(f"substring(seq, {CELL} * h + 1)"))
    return rows.select("conv_id", seq.alias("seq"))


# ------------------------------------------------------------------ ends


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    key, ids = None, []
    for batch in batches:
        out = []
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or len(ids) >= most):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["key", "at", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "at", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        keys, ends = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if state:
                    keys.append(key)
                    ends.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ends, pa.string())], names=["key", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends"])


def ends_of(members: DataFrame, most: int = 65_536) -> DataFrame:
    """(key, ends): SHA-256 of the comma-joined ascending conv_ids of each key, hashed piece after piece."""
    dealt = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = dealt.mapInArrow(partial(_pieces, most=most), "key string, at long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_digests, "key string, ends string")


# ------------------------------------------------------------------ merging


def shared_cells(a: bytes, b: bytes, start: int = 0) -> int:
    """Cells that two sequences share, the first ``start`` being known to be equal."""
    most = min(len(a), len(b)) // CELL
    while start < most and a[start * CELL : (start + 1) * CELL] == b[start * CELL : (start + 1) * CELL]:
        start += 1
    return start


def sorted_run(rows: list[tuple]) -> list[tuple[int, tuple]]:
    """Rows (seq, ...) in order, each with its LCP with the row before."""
    rows = sorted(rows, key=lambda r: r[0])
    return [(shared_cells(rows[i - 1][0], r[0]) if i else 0, r) for i, r in enumerate(rows)]


def merged(runs: list[list[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """All rows of sorted runs in order with their LCPs, by a loser tree.

    Every contender's LCP is that with the last row put out: the greater one
    wins unseen; only where both are equal are cells compared, from there on,
    and the loser's LCP with the winner is remembered.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    place = [0] * k
    lcp = [0 if i < len(runs) and runs[i] else -1 for i in range(k)]

    def play(a: int, b: int) -> tuple[int, int]:
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = runs[a][place[a]][1][0], runs[b][place[b]][1][0]
        at = shared_cells(x, y, lcp[a])
        win, lose = (a, b) if x[at * CELL : (at + 1) * CELL] <= y[at * CELL : (at + 1) * CELL] else (b, a)
        lcp[lose] = at
        return win, lose

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    while lcp[best] >= 0:
        yield lcp[best], runs[best][place[best]][1]
        place[best] += 1
        lcp[best] = runs[best][place[best]][0] if place[best] < len(runs[best]) else -1
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


# ------------------------------------------------------------------ nodes


@dataclass(slots=True)
class Node:
    ord: int
    first: bool
    depth: int
    key: bytes
    parent: bytes | None
    words: int
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved_tokens: int = 0
    ends: str | None = None

    def add(self, conv_id: int | None, n_convs: int, n_leaves: int, saved_tokens: int, n_children: int = 0, ends: str | None = None) -> None:
        self.conv_id = conv_id if self.conv_id is None else self.conv_id if conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs
        self.n_leaves += n_leaves
        self.saved_tokens += saved_tokens
        self.n_children += n_children
        self.ends = self.ends or ends


class OpenPath:
    """The stack of nodes from the root to where the stream is.

    A node that is left is finished and added to its parent, unless it lies on
    the range's first path: that one, and the path open at the end, may go on
    in a neighbouring range and are put out open, without their open children.
    """

    def __init__(self, part: int, whole: bool) -> None:
        self.part, self.whole, self.stack, self.made, self.out = part, whole, [], 0, []

    def push(self, first: bool, depth: int, key: bytes, parent: bytes | None, words: int) -> Node:
        node = Node(self.made, first and not self.whole, depth, key, parent, words)
        self.made += 1
        self.stack.append(node)
        return node

    def leave(self, size: int) -> None:
        """Close nodes until ``size`` are open."""
        while len(self.stack) > size:
            node = self.stack.pop()
            if not node.first:
                node.n_leaves = node.n_leaves if node.n_children else 1
                node.saved_tokens += (node.n_convs - 1) * node.words
                if self.stack:
                    self.stack[-1].add(node.conv_id, node.n_convs, node.n_leaves, node.saved_tokens, 1)
            self._emit(node, not node.first)

    def end(self) -> None:
        if self.whole:
            self.leave(0)
        while self.stack:
            self._emit(self.stack.pop(), False)

    def _emit(self, n: Node, done: bool) -> None:
        self.out.append((self.part, n.ord, done, n.first, n.depth, n.key, n.parent, n.words, n.conv_id, n.n_convs, n.n_children, n.n_leaves, n.saved_tokens, n.ends))

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
        kinds = [types[c.split()[1]] for c in _OPEN.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_COLUMNS)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = []
    for batch in batches:
        if batch.num_rows:
            runs.append(sorted_run(list(zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "low", "ends"))))))
    if not runs:
        return
    path, first = OpenPath(TaskContext.get().partitionId(), whole=False), True
    path.push(True, 0, _ROOT, None, 0)
    for lcp, (seq, n, low, ends) in merged(runs):
        path.leave(lcp + 1)
        for at in range(lcp, len(seq) // CELL):
            own = seq[at * CELL : (at + 1) * CELL]
            above = path.stack[-1].key
            path.push(first, at + 1, hashlib.blake2b(above + own, digest_size=16).digest(), above, int.from_bytes(own[16:], "big"))
        path.stack[-1].add(low, n, 0, 0, ends=ends)
        first = False
        if len(path.out) >= 10_000:
            yield path.batch()
    path.end()
    yield path.batch()


def _joined(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    path, group, began = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["group"] != group:
                if path:
                    path.end()
                    yield path.batch()
                group, began = row["group"], row["range"]
                path = OpenPath(group, whole)
            at = row["depth"]
            if len(path.stack) <= at or path.stack[at].key != row["key"]:
                path.leave(at)
                path.push(row["first"] and row["range"] == began, at, row["key"], row["parent"], row["words"])
            path.stack[at].add(row["conv_id"], row["n_convs"], row["n_leaves"], row["saved_tokens"], row["n_children"], row["ends"])
    if path:
        path.end()
        yield path.batch()


def trie(members: DataFrame, range_bytes: int = 32_000_000) -> DataFrame:
    """Nodes of the trie of sequences (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = cut(members.withColumn("key", F.sha2("seq", 256)), "members")
    classes = members.groupBy("key").agg(F.any_value("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    classes = cut(classes.join(ends_of(members), "key").select("seq", "n", "low", "ends"), "classes")
    size = classes.agg(F.sum(F.octet_length("seq") + 120)).first()[0] or 0
    made = cut(classes.repartitionByRange(max(1, math.ceil(size / range_bytes)), "seq").mapInArrow(_nodes, _OPEN), "nodes")
    nodes = made.where("done")
    while True:
        open_ = made.where("not done")
        last = open_.agg(F.max("range")).first()[0]
        if last is None:
            break
        grouped = open_.withColumn("group", F.expr(f"range div {FAN}").cast("int"))
        ordered = grouped.repartition("group").sortWithinPartitions("group", "range", "ord")
        made = cut(ordered.mapInArrow(partial(_joined, whole=last < FAN), _OPEN), "nodes")
        nodes = nodes.union(made.where("done"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(cut(sequences(conversations), "sequences")))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""

ORACLE = rf"""WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS s, ({_CRC}) % 4 AS h FROM t GROUP BY conv_id),
b AS (SELECT o.conv_id, list_concat(coalesce(f.s[1:o.h], []), o.s[o.h + 1:]) AS s FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
x AS (SELECT conv_id, s, list_transform(s, lambda e: e.k) AS ks, unnest(range(0, len(s) + 1)) AS d FROM b),
p AS (SELECT conv_id, d, d = len(s) AS last, sha256(array_to_string(ks[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(ks[1:d - 1], ',')) END AS up,
  CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w FROM x),
n AS (SELECT k, d, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY k, d),
c AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT DISTINCT q.k AS top, p.k FROM p JOIN p q ON p.conv_id = q.conv_id AND q.d <= p.d),
u AS (SELECT top, sum((n.n_convs - 1) * n.w)::BIGINT AS saved_tokens, count(*) FILTER (WHERE c.up IS NULL) AS n_leaves FROM a JOIN n ON n.k = a.k LEFT JOIN c ON c.up = n.k GROUP BY top)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n m ON m.k = n.up LEFT JOIN c ON c.up = n.k JOIN u ON u.top = n.k"""

"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n int"


def _brute(sequences):
    nodes = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for s, members in nodes.items():
        under = [k for k in nodes if k[: len(s)] == s]
        children = [k for k in under if len(k) == len(s) + 1]
        ends = sorted(c for c in members if len(sequences[c]) == len(s))
        saved = sum((len(nodes[k]) - 1) * words(k[-1][1]) for k in under if k)
        leaves = sum(1 for k in under if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in under))
        parent = min(nodes[s[:-1]]) if s else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(s), parent, len(members), len(children), leaves, saved, digest))
    return sorted(out, key=str)


def _rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def _run(spark, rows):
    found = pt.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_rebuilt_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(140), 90):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "x  y\tz"]), "d", 1))
    rows += [(141, None, "user", "first", "d", 1), (141, 0, "user", "second", "d", 1), (None, 0, "user", "lost", "d", 1), (-3, 0, "u", "t", "d", 1)]
    rng.shuffle(rows)
    plain = [r for r in rows if r[0] is None or r[0] >= 0]
    assert _run(spark, plain) == _brute(_rebuilt(plain))
    assert len(_run(spark, rows)) > 0


def test_an_empty_table_has_no_root(spark):
    assert _run(spark, []) == []


def _members(spark, sequences):
    rows = [(c, "".join(hashlib.sha256(t.encode()).hexdigest()[:32] + f"{len(t.split()):016x}" for _, t in s)) for c, s in sequences.items()]
    return spark.createDataFrame(rows, "conv_id bigint, x string").select("conv_id", F.unhex("x").alias("seq"))


@pytest.mark.parametrize("range_bytes", [10**9, 400])
def test_ranges_and_their_open_paths(spark, range_bytes):
    """Many ranges cut through shared, hot and very long paths; their joined nodes are those of one range."""
    rng = random.Random(9)
    hot = [("u", f"turn {i}") for i in range(40)]
    sequences = {c: hot[: rng.choice([0, 1, 39, 40])] + [("u", f"t{rng.randrange(3)}")] * rng.choice([0, 0, 1, 2]) for c in range(150)}
    sequences |= {1000 + c: [("u", f"x{rng.randrange(4)}") for _ in range(rng.randrange(7))] for c in range(150)}
    got = pt.trie(_members(spark, sequences), range_bytes)
    plain = {c: [("", t) for _, t in s] for c, s in sequences.items()}
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(plain)


def test_more_than_one_level_of_ranges(spark):
    sequences = {c: [("u", f"a{(c * 7919) % 3}")] + [("u", f"b{c % 50}"), ("u", f"c{c}")] for c in range(300)}
    got = pt.trie(_members(spark, sequences), 300)  # some 200 ranges: two rounds of joins
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute({c: [("", t) for _, t in s] for c, s in sequences.items()})


def test_loser_tree_keeps_order_and_prefixes():
    rng = random.Random(1)
    word = lambda: b"".join(bytes([rng.randrange(3)]) * pt.CELL for _ in range(rng.randrange(8)))
    for k in (1, 2, 3, 7, 16):
        runs = [pt.sorted_run([(word(),) for _ in range(rng.randrange(30))]) for _ in range(k)]
        got = list(pt.merged(runs))
        rows = [r[0] for _, r in got]
        assert rows == sorted(r[0] for run in runs for _, r in run)
        assert [h for h, _ in got] == [0 if i == 0 else pt.shared_cells(rows[i - 1], rows[i]) for i in range(len(rows))]


def test_ids_are_hashed_in_pieces(spark):
    members = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("conv_id")).union(spark.range(3).select(F.lit("j"), F.col("id") * -1))
    got = dict(tuple(r) for r in pt.ends_of(members, most=7).collect())
    assert got == {"k": hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest(), "j": hashlib.sha256(b"-2,-1,0").hexdigest()}

"""What a query makes on its way must not outgrow its input: small cases whose figures told the difference."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import blocks, clustering, ranking, review, similarity, vector_index
from tessera.plans import library_queries, registry
from tessera.sources import files, folder_source
from tessera.streaming import folds, signatures


def test_set_pairs_in_chunks(spark, monkeypatch):
    """The pairs of plain loops, over several chunks and buckets; only links are written, however many sets share frequent tokens."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "SLABS", 2)
    rng = random.Random(5)
    rows = []
    for i in range(240):
        size = rng.choice([1, 2, 5, 20, 60, 300])
        words = {f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(size)} | {"the", "of"}
        rows.append((rng.choice(["en", "de", ""]), i, sorted(words)))
    rows += [("en", 240 + i, [*rows[i][2], "new"]) for i in range(20)] + [(None, 300, ["a"]), (None, 301, ["a", "b"]), ("en", 302, [])]
    found = similarity.set_pairs(spark.createDataFrame(rows, "bucket string, id bigint, tokens array<string>"), 0.3).collect()
    want = {}
    for x, (p, a, s) in enumerate(rows):
        for q, b, t in rows[x + 1 :]:
            if p is not None and p == q and s and t and len({*s} & {*t}) / len({*s} | {*t}) >= 0.3:
                want[p, a, b] = len({*s} & {*t}) / len({*s} | {*t})
    assert {(r.bucket, r.a, r.b): r.sim for r in found} == want and len(found) == len(want) > 100


def test_candidates_stay_in_their_task(spark, monkeypatch):
    """400 sets that all share ten tokens of forty have no link; what is written besides the sets is empty."""
    made = []
    kept = blocks.scratch_path
    monkeypatch.setattr(blocks, "scratch_path", lambda s, name: made.append(kept(s, name)) or made[-1])
    rows = [("en", i, [f"c{k}" for k in range(10)] + [f"own{i}-{k}" for k in range(30)]) for i in range(400)]
    assert similarity.set_pairs(spark.createDataFrame(rows, "bucket string, id bigint, tokens array<string>"), 0.3).isEmpty()
    assert len(made) == 1 and spark.read.parquet(made[0]).isEmpty()


def test_only_linked_tokens_are_written(spark, monkeypatch):
    """200 sets with two links among them: all are written as hashes, the tokens of the four linked ones alone; rows are numbered with one shuffle."""
    made = []
    kept = similarity.table_of
    monkeypatch.setattr(similarity, "table_of", lambda df, *name: made.append(kept(df, *name)) or made[-1])
    rows = [("en", i, [f"w{i // 2 if i < 4 else i}-{k}" for k in range(30)] + [f"x{i}"]) for i in range(200)] + [("en", 200, [f"w0-{k}" for k in range(30)] + ["x0"])]
    links = {r.id: (r.rep, r.n_links) for r in similarity.jaccard_links(spark.createDataFrame(rows, "bucket string, id bigint, tokens array<string>"), 0.3).collect()}
    assert links == {i: (0 if i == 200 else i, 2 if i in (0, 1, 200) else 1 if i in (2, 3) else 0) for i in range(201)}
    texts = [t for t in made if any(kind == "array<string>" or c == "w" for c, kind in t.dtypes)]
    assert [t.count() for t in texts] == [4]
    numbered = blocks.numbered(spark.range(100), [F.asc("id")])
    assert "hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_sets_meet_by_rare_tokens():
    """400 sets that share ten frequent tokens of forty are not compared; a row looks up its rare tokens and finds the sets that share some, in its bucket alone."""
    shared = similarity._MARKS + np.arange(10)
    h = [[*range(30 * i, 30 * i + 30), *shared] for i in range(400)]
    h[300] = [*range(0, 25), *range(9030, 9035), *shared]  # shares 35 tokens with the first
    chunk = pa.table({"bucket": ["de"] * 5 + ["en"] * 395, "id": range(400), "position": range(1, 401), "n": [40] * 400, "h": pa.array(h, pa.list_(pa.int32()))})
    for twin, bucket in ((300, "en"), (300, "de")):
        index = similarity._Index(chunk.set_column(0, "bucket", [["de"] * (300 if bucket == "de" else 5) + ["en"] * (100 if bucket == "de" else 395)]), 0.3)
        assert sum(len(index.rows[i:j]) for i, j in zip(index.lists, index.lists[1:])) == 400 * 24 and index.keys.max() % (2 * similarity._MARKS) < similarity._MARKS
        counts = index.counts(index.bucket["en"], np.array(h[twin])[:24], 400)
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == {300: 24}
    index = similarity._Index(chunk.set_column(0, "bucket", [["en"] * 400]), 0.3)
    counts = index.counts(0, np.array(h[300])[:24], 400)
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == {0: 24, 300: 24}
    seen = similarity._sharing(chunk.set_column(0, "bucket", [["en"] * 400]).to_batches(), SimpleNamespace(value=chunk.set_column(0, "bucket", [["en"] * 400])), 0.3)
    assert [(r["a"], r["b"]) for b in seen for r in b.to_pylist()] == [(0, 300)]


def test_rare_first_and_every_threshold(spark, monkeypatch):
    """With few ranked tokens and many that share a hash the pairs are those of plain loops, at any threshold."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = random.Random(9)
    rows = [("en", i, sorted({f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.choice([1, 3, 9, 40, 120]))})) for i in range(150)]
    for marks in (2**22, 64):
        own = [("en", i, [hash_of % marks for hash_of in (int(w[1:]) * 7919 for w in t)]) for _, i, t in rows]
        for t in (0.05, 0.3, 0.75, 1.0):
            order = sorted(own, key=lambda r: (len(r[2]), r[1]))
            table = pa.table({"bucket": ["en"] * 150, "id": [r[1] for r in order], "position": range(1, 151), "n": [len(r[2]) for r in order], "h": pa.array([sorted(r[2]) for r in order], pa.list_(pa.int32()))})
            found = {(r["a"], r["b"]) for i in range(0, 150, 40) for b in similarity._sharing(table.to_batches(), SimpleNamespace(value=table.slice(i, 40).combine_chunks()), t) for r in b.to_pylist()}
            sets = {i: {*w} for _, i, w in rows}
            want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
            assert want <= found and (marks == 64 or found == want)


def test_tokens_are_made_for_linked_rows(spark, monkeypatch):
    """The second making of tokens comes after the choice of rows."""
    plans = []
    kept = similarity.table_of
    monkeypatch.setattr(similarity, "table_of", lambda df, *name: ("w" in df.columns and plans.append(df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, *name))
    rows = spark.range(20).select(F.lit("en").alias("bucket"), "id", F.split(F.concat(F.lit("x y z "), F.col("id").cast("string")), " ").alias("tokens"))
    assert similarity.jaccard_links(rows, 0.3).count() == 20
    assert len(plans) == 1 and plans[0].index("split(") < plans[0].index("LeftSemi")


def test_a_log_is_streamed(spark):
    """a part's log comes in batches and is not held; snapshots are kept only of what some undo names."""
    columns = ["part", *review._FOLD_COLUMNS]
    rows = [(1, str(i), "swipe", 7, None, None, "up", None, None, i == 3) for i in range(6)] + [(1, "9", "undo", None, None, None, None, None, "3", False)]
    schema = pa.schema([("part", pa.int64()), ("action_id", pa.string()), ("mode", pa.string()), *((c, pa.int64()) for c in ("image_id", "left", "right")),
                        ("gesture", pa.string()), ("winner", pa.int64()), ("undo_of", pa.string()), ("undone", pa.bool_())])
    batches = (pa.RecordBatch.from_pylist([dict(zip(columns, r))], schema=schema) for r in rows)
    assert [b.to_pylist() for b in review._folded(batches)] == [[{"image_id": 7, "score": 65.0, "hidden": False}]]
    done = review.Fold()
    for r in rows:
        done.add(dict(zip(columns, r)))
    assert list(done.taken) == ["3"]


def test_many_folders_are_few_partitions(spark, tmp_path):
    """600 folders on three levels make no 600 tasks, all files are found, and templates are opened without a list of folders."""
    for i in range(300):
        folder = tmp_path / f"top{i % 20}" / f"f{i} a%20b"
        folder.mkdir(parents=True)
        (folder / f"t{i}.json").write_text('{"id": "w%d", "nodes": [{"id": 1, "type": "KSampler"}]}' % i)
    listed = lambda: folder_source.folder_listing(spark, str(tmp_path), depth=2, suffixes="json")
    listing = listed()
    assert listing.rdd.getNumPartitions() <= 40 and listing.count() == 300
    assert listed().where("depth = 1").count() == 0 and listed().where(F.col("folder").endswith("f7 a%20b")).count() == 1
    assert {r.workflow_id for r in files.templates_of(spark, listing).collect()} == {f"w{i}" for i in range(300)}
    (tmp_path / "top3" / "f3 a%20b" / "t3.json").unlink()
    assert files.templates_of(spark, listing.union(listing.limit(1))).count() == 299


def test_swapped_files_meet_by_equality(spark):
    """the pairs of files that swap contents are an equi-join, and the same ones."""
    assert library_queries._SWAPPED in library_queries._FILES
    spark.range(40).selectExpr("id", "id % 10 AS d").createOrReplaceTempView("swapping")
    said = "SELECT x.id, y.id AS other FROM swapping x JOIN swapping y ON "
    found = spark.sql(said + library_queries._PARTNER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(found.collect()) == sorted(spark.sql(said + library_queries._SWAPPED).collect()) == [(i, i + (1 if i % 10 == 5 else -1)) for i in range(40) if i % 10 in (5, 6)]


def test_index_lists_do_not_travel(spark, monkeypatch):
    """Vectors without structure probe every list, yet none is copied for it; pairs and neighbours are those of plain loops, over several chunks."""
    monkeypatch.setattr(blocks, "BLOCK", 32)
    monkeypatch.setattr(blocks, "SLABS", 2)
    made = []
    kept = blocks.table_of
    for module in (blocks, vector_index):
        monkeypatch.setattr(module, "table_of", lambda df, *name: made.append(kept(df, *name)) or made[-1])
    x = np.random.default_rng(3).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([("abc"[i % 3], i, x[i].tolist()) for i in range(300)], "bucket string, id bigint, vec array<double>")
    index = vector_index.build(rows, vector_index.IndexOptions(rows=20))
    sims, own = x @ x.T, np.arange(300) % 3
    same = own[:, None] == own[None, :]
    assert {(r.a, r.b) for r in vector_index.close_pairs(index, 0.3).collect()} == {(a, b) for a, b in np.argwhere(same & (sims >= 0.3)) if a < b}
    near = np.where(same & ~np.eye(300, dtype=bool), sims, -2).max(axis=1)
    assert all(abs(r.sim - near[r.id]) < 1e-9 for r in vector_index.nearest(index).collect())
    others = {r.id: r.near for r in vector_index.nearest(index, same=False).collect()}
    assert others == {i: "abc"[own[np.where(same, -2, sims)[i].argmax()]] for i in range(300)}
    assert max(t.count() for t in made) == 300


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """a group's pairs meet the recent ones in as many tasks as they are many, however small the rows are."""
    monkeypatch.setattr(ranking, "PAIRS", 100)
    rows = spark.createDataFrame([("g", i, 50.0, 0.4) for i in range(100)], "group_key string, id bigint, score double, staleness double")
    found = ranking.arena_pairs(rows, spark.createDataFrame([(2, 1), (1, 2), (98, 99)], "a bigint, b bigint"))
    assert found.rdd.getNumPartitions() == 50 and found.count() == 4950
    assert {(r.a, r.b) for r in found.where("weight < 0.5").collect()} == {(1, 2), (98, 99)}


def test_rows_alike_but_for_own_tokens_are_one(spark):
    """300 rows of two groups share two tokens; what meets on them is a few rows, not 150 x 150."""
    rows = spark.createDataFrame([("a" if i % 2 else "b", i, [f"own{i}", "x", f"y{i // 2 % 2}"]) for i in range(300)], "group_key string, id bigint, tokens array<string>")
    found = similarity.suggest_by_tokens(rows.where("id % 3 = 0"), rows)
    assert [(r.group_key, r.other_group, round(r.score, 9), r["count"]) for r in found.collect()] == [("a", "b", 0.5, 150), ("b", "a", 0.5, 150)]
    folds = similarity.folded_tokens(rows.select("group_key", "id", F.col("tokens").alias("w")), ["group_key", "id"], spark.createDataFrame([("x",), ("y0",), ("y1",)], "token string"))
    assert folds.count() == 4


def test_a_chunk_is_spread(spark, tmp_path):
    """F8: a chunk, which is one file, is dealt over the session's tasks before the tower sees it."""
    seen = []
    images = spark.range(40).select("id", F.concat(F.lit("a word"), "id").alias("prompt_pos"), F.lit("/p").alias("abs_path"))
    job = signatures.SignatureJob(spark, str(tmp_path / "job"), "text", "spread", lambda rows: seen.append(rows.rdd.getNumPartitions()) or signatures.hashed_words()(rows))
    job.plan(images, chunk=100)
    job.start()
    assert job.wait().done == 40 and seen == [spark.sparkContext.defaultParallelism]


def test_average_linkage_keeps_no_pairs(spark, monkeypatch):
    """in rounds over tables as in a task, no table holds more than the clusters; ties agree, and the weights of many copies do not overflow."""
    made = []
    for module in (clustering, blocks):
        monkeypatch.setattr(module, "table_of", lambda df, *name, kept=module.table_of: made.append(kept(df, *name)) or made[-1])
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (90, 6)) + 0.0
    x[:, 0] = 1
    x = np.concatenate([x, rng.normal(size=(90, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"b{i % 2}", i, v.tolist()) for i, v in enumerate(x)], "bucket string, id bigint, vec array<double>")
    whole = {r.id: r.cluster for r in clustering.average_linkage(df, 0.5).collect()}
    assert whole == {r.id: r.cluster for r in clustering.average_linkage(df, 0.5, fits=40).collect()} and 2 < len(set(whole.values())) < 150
    assert len(made) > 8 and max(t.count() for t in made) <= len(x)
    copies = spark.range(120_000).select(F.lit("k").alias("bucket"), "id", F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.8), F.lit(0.6))).alias("vec"))
    assert clustering.average_linkage(copies, 0.5).where("cluster <> 0").isEmpty()


def test_scores_are_kept_by_shard(spark):
    """a thousand images of a shard cost as many state calls as one; late order, timers and both sides of the watermark give the scores of a plain loop."""
    calls, kept, timers = [], [], []
    value = SimpleNamespace(exists=lambda: calls.append("exists") or bool(kept), get=lambda: calls.append("get") or kept[-1], update=lambda v: calls.append("update") or kept.append(v))
    fold = folds.ScoreFold()
    fold.init(SimpleNamespace(getValueState=lambda *a: value, registerTimer=timers.append))
    rng = random.Random(3)
    swipes = [(rng.randrange(1000), rng.randrange(10**9), i, rng.choice([*folds.SWIPE_STEPS])) for i in range(20_000)]
    clock, got = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0), {}
    halves = [pd.DataFrame(part, columns=["image_id", "at_us", "seq", "gesture"]) for part in (swipes[:10_000], swipes[10_000:])]
    for half in halves:
        got |= {r.image_id: r for out in fold.handleInputRows((7,), iter([half[:300], half[300:]]), clock) for r in out.itertuples()}
    clock.getCurrentWatermarkInMs = lambda: 500_000
    timed = {r.image_id: r for out in fold.handleExpiredTimer((7,), clock, None) for r in out.itertuples()}
    assert list(fold.handleExpiredTimer((7,), clock, None)) == []
    want, passed = {}, {}
    for image, at, _, gesture in sorted(swipes):
        want[image] = max(0.0, min(100.0, want.get(image, 50.0) + folds.SWIPE_STEPS[gesture]))
        passed[image] = passed.get(image, 0) + (at <= 500_000_000)
    assert {i: r.score for i, r in got.items()} == want and {i: r.score for i, r in timed.items()} == {i: want[i] for i in timed}
    assert {i: r.folded for i, r in timed.items()} == {i: n for i, n in passed.items() if n} and sum(r.folded + r.waiting for r in timed.values()) == 20_000
    assert len(calls) < 12 and timers[-1] > 500_000
    stream = spark.readStream.format("rate").load().selectExpr("value image_id", "'up' gesture", "timestamp at", "value seq")
    assert "shard" in folds.streamed_scores(stream)._jdf.queryExecution().analyzed().toString()


def test_arena_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """few small rows that make many pairs are many tasks, and every pair comes once."""
    monkeypatch.setattr(ranking, "BLOCK_PAIRS", 50, raising=False)
    monkeypatch.setattr(ranking, "in_blocks", lambda rows, bucket, key: blocks.in_blocks(rows, bucket, key, size=4))
    rows = spark.range(100).select(F.lit("g").alias("group_key"), "id", F.lit(1.0).alias("score"), F.lit(0.4).alias("staleness"))
    pairs = ranking.arena_pairs(rows)
    assert pairs.rdd.getNumPartitions() == 100
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a, b) for a in range(100) for b in range(a + 1, 100)]


def test_arena_pairs_do_little_for_a_pair(spark):
    """a cell's rows are found by one number, what a row alone decides is computed before, and weights are rounded without decimals, to what decimals give."""
    rows = spark.range(60).select(
        F.when(F.col("id") % 3 > 0, "g").otherwise("h").alias("group_key"), "id", F.when(F.col("id") % 7 > 0, (F.col("id") * 17 % 101).cast("double")).alias("score"), ((F.col("id") % 11) / 10.0).alias("staleness")
    )
    pairs = ranking.arena_pairs(rows)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join Inner")]
    assert "coalesce" not in top and "0.6" not in top and "struct" not in plan
    same = pairs.select("group_key", "a", "b", F.round("weight", 6).alias("r"), registry._sixth("weight").alias("s")).collect()
    assert sorted((r.group_key, r.a, r.b) for r in same) == sorted(("gh"[a % 3 == 0], a, b) for a in range(60) for b in range(a + 1, 60) if (a % 3 == 0) == (b % 3 == 0))
    assert all(r.r == r.s for r in same)
    w1 = registry.queries()["w1_arena_pairs"](spark, "/root/testdata/sf0.001")
    assert "round(" not in w1._jdf.queryExecution().optimizedPlan().toString().lower()

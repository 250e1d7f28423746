"""Domain operators on small literal inputs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import token_set
from tessera.operators import clustering, export, graphs, groups, identity, ranking, recommend, reconcile, review, similarity
from tessera.operators.blocks import in_blocks, numbered


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lora_groups_count_images_once(spark):
    schema = "id bigint, source_id bigint, hidden boolean, loras array<struct<name: string, strength: double>>"
    data = [(1, 1, False, [("a", 1.0)]), (2, 1, False, [("b", 1.0), ("a", 1.0), ("a", 0.5)]), (3, 1, False, []), (4, 1, True, [("a", 1.0)])]
    found = groups.lora_groups(spark.createDataFrame(data, schema))
    assert rows(found) == [("lora-single:(unknown)", 1), ("lora-single:a", 2), ("lora-single:b", 1)]


def test_recommendation_shrinks_and_defaults(spark):
    data = [(1, "p", "", "r", 100.0), (2, "p", "", "r", None), (3, "q", "", "r", 60.0)]
    found = {r.prompt_pos: r for r in recommend.recommend(spark.createDataFrame(data, "id bigint, prompt_pos string, prompt_neg string, recipe_signature string, score double")).collect()}
    p = found["p"]
    assert (p.n, p.mean_score, p.median_score, p.variance, p.example_ids) == (2, 75.0, 75.0, 625.0, [1, 2])
    assert p.shrunk_score == pytest.approx(75 * 2 / 7 + 50 * 5 / 7)
    assert recommend.recommend_prompts(spark.createDataFrame(data, "id bigint, prompt_pos string, prompt_neg string, recipe_signature string, score double"), 3).count() == 0


def brute_pairs(sets, t):
    out = set()
    for (b1, i, x) in sets:
        for (b2, j, y) in sets:
            if b1 == b2 and i < j:
                sim = 1.0 if not x and not y else len(x & y) / len(x | y)
                if sim >= t:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_jaccard_pairs_match_brute_force(spark, threshold):
    rng = random.Random(3)
    sets = [("x" if i % 3 else "y", i, {f"w{rng.randint(0, 14)}" for _ in range(rng.randint(0, 9))}) for i in range(60)]
    df = spark.createDataFrame([(b, i, sorted(s)) for b, i, s in sets], "bucket string, id bigint, tokens array<string>")
    found = {(r.a, r.b) for r in similarity.jaccard_pairs(df, threshold).collect()}
    want = brute_pairs(sets, threshold)
    empties = {p for p in want if not sets[p[0]][2]}
    assert found - empties == want - empties and found <= want
    clusters = {r.id: r.cluster for r in clustering.single_linkage(df, threshold).collect()}
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted(want):
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert clusters == {i: find(i) for i in range(60)}


def test_single_linkage_chains(spark):
    prompts = [(1, "a, b"), (2, "b, c"), (3, "c, d")]
    df = spark.createDataFrame(prompts, "id bigint, p string").select(F.lit("k").alias("bucket"), "id", token_set(F.col("p")).alias("tokens"))
    assert {r.cluster for r in clustering.single_linkage(df, 0.33).collect()} == {1}
    assert {r.cluster for r in clustering.single_linkage(df, 0.0).collect()} == {1}


def test_average_linkage_does_not_chain(spark):
    v = [("k", 1, [1.0, 0.0, 0.0]), ("k", 2, [0.9, 0.44, 0.0]), ("k", 3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(v, "bucket string, id bigint, vec array<float>")
    c = {r.id: r.cluster for r in clustering.average_linkage(df, 0.6).collect()}
    assert c[1] == c[2] != c[3]


def naive_average(v, t):
    members = [[i] for i in range(len(v))]
    while len(members) > 1:
        best = max(((np.mean([v[a] @ v[b] for a in x for b in y]), -i, -j) for i, x in enumerate(members) for j, y in enumerate(members) if i < j))
        if best[0] < t:
            break
        i, j = -best[1], -best[2]
        members = [m for k, m in enumerate(members) if k not in (i, j)] + [members[i] + members[j]]
    return {frozenset(m) for m in members}


def test_average_linkage_matches_the_definition(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5)).astype(np.float32)
    v[30:34] = v[3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("x" if i < 35 else "y", i, x.tolist()) for i, x in enumerate(v)], "bucket string, id bigint, vec array<float>")
    for t in (0.2, 0.5, 0.9):
        got = defaultdict(set)
        for r in clustering.average_linkage(df, t).collect():
            got[r.cluster].add(r.id)
        assert all(k == min(g) for k, g in got.items())
        want = naive_average(v[:35].astype(float), t) | {frozenset(i + 35 for i in g) for g in naive_average(v[35:].astype(float), t)}
        assert {frozenset(g) for g in got.values()} == want


def test_blocks_meet_once(spark):
    rows_ = spark.createDataFrame([("k" if i % 4 else "l", i) for i in range(200)], "bucket string, id bigint")
    placed = in_blocks(rows_, "bucket", "id", size=16)
    a = placed.where("side = low").select("bucket", "low", "high", F.col("id").alias("a"))
    b = placed.where("side = high").select("bucket", "low", "high", F.col("id").alias("b"))
    met = [tuple(sorted((r.a, r.b))) for r in a.join(b, ["bucket", "low", "high"]).where("a <> b and (low < high or a < b)").collect()]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if (i % 4 == 0) == (j % 4 == 0)}
    assert len(met) == len(want) and set(met) == want


def test_numbered_rows_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "x bigint, id bigint")
    assert [r.position for r in numbered(df, [F.desc("x")]).orderBy(F.desc("x")).collect()] == list(range(1, 102))
    assert numbered(df.limit(0), [F.desc("x")]).count() == 0


def test_merge_then_unmerge(spark):
    images = spark.createDataFrame([(1, 1, "k1", "a"), (2, 1, "k2", "b"), (3, 1, "k3", "c")], "id bigint, source_id bigint, group_key_l2 string, prompt_pos string")
    bound = clustering.merge_groups(images, ["k1", "k2"])
    key = bound.first().group_key
    restored, left = clustering.unbind(images, bound, key, "merge")
    assert rows(restored) == [(1, "k1"), (2, "k2")] and left.count() == 0
    assert clustering.unbind(images, left, key, "merge")[0].count() == 0
    with pytest.raises(ValueError):
        clustering.unbind(images, bound, key, "move")


FILES = "id bigint, content_key string, meta_sig string, content_fp string"


@pytest.mark.parametrize("old,new,want", [
    ([(1, "k", "m", "h")], [(9, "k", "n", "g")], [(1, 9, "content_key")]),
    ([(1, "k", "m", "h")], [(8, "k", "m", "x"), (9, "k", "n", "y")], [(1, 8, "metadata")]),
    ([(1, "k", "m", "h")], [(8, "k", "m", "h"), (9, "k", "m", "y")], [(1, 8, "content_hash")]),
    ([(1, "k", "m", "h")], [(8, "k", "m", "h"), (9, "k", "m", "h")], []),
    ([(1, "k", "m", "h"), (2, "k", "m", "h")], [(9, "k", "m", "h")], []),
    ([(1, "", "", "")], [(9, "", "", "")], []),
])
def test_match_files(spark, old, new, want):
    assert rows(identity.match_files(spark.createDataFrame(old, FILES), spark.createDataFrame(new, FILES))) == want


def test_recovery_keeps_what_is_new(spark):
    def library(ids, labels, tagged, scores, bound):
        images = spark.createDataFrame([(i, f"k{i % 100}", "", "", "g") for i in ids], FILES + ", group_key_l2 string")
        return {
            "images": images, "labels": spark.createDataFrame(labels, "id bigint, name string"), "image_labels": spark.createDataFrame(tagged, "image_id bigint, label_id bigint"),
            "scores": spark.createDataFrame(scores, "image_id bigint, internal_score double"),
            "manual_group_bindings": spark.createDataFrame(bound, "level int, image_id bigint, group_key string, kind string, prev_group_key string"),
        }

    old = library([1, 2], [(5, "good")], [(1, 5), (2, 5)], [(1, 80.0), (2, 70.0)], [(2, 1, "m", "merge", "x")])
    new = library([101, 102], [(7, "good")], [(101, 7)], [(102, 10.0)], [])
    plan = reconcile.plan_recovery(old, new)
    assert rows(plan.labels) == [(102, 7)] and rows(plan.scores) == [(101, 80.0, "recovered")]
    assert rows(plan.bindings) == [(2, 101, "m", "merge", None)]
    assert dict(rows(plan.preview()))["matches"] == 2


def act(k, mode, **x):
    return {"action_id": f"{k:03}", "mode": mode, "image_id": None, "left": None, "right": None, "gesture": None, "winner": None, "undo_of": None} | x


def test_undo_restores_the_snapshot():
    log = [act(1, "arena", left=1, right=2, winner=1), act(2, "undo", undo_of="001")]
    assert review.fold(log) == ({}, {1: False, 2: False}, [])
    log = [act(0, "swipe", image_id=1, gesture="right"), act(1, "arena_hide", left=1, right=2, winner=1), act(2, "undo", undo_of="001"), act(3, "undo", undo_of="001")]
    assert review.fold(log)[0] == {1: 60.0}
    log = [act(1, "hide", image_id=4), act(2, "unhide", image_id=4), act(3, "undo", undo_of="002")]
    assert review.fold(log)[:2] == ({4: 0.0}, {4: False})


def test_review_state_equals_the_whole_fold(spark):
    rng = random.Random(5)
    log = []
    for k in range(120):
        if rng.random() < 0.3:
            a, b = rng.sample(range(30), 2)
            log.append(act(k, rng.choice(["arena", "arena_hide"]), left=a, right=b, winner=rng.choice([a, b])))
        elif rng.random() < 0.2 and log:
            log.append(act(k, "undo", undo_of=rng.choice([e for e in log if e["mode"] != "undo"])["action_id"]))
        else:
            log.append(act(k, rng.choice(["swipe", "hide", "unhide"]), image_id=rng.randrange(30), gesture=rng.choice(["left", "right", "up", "down"])))
    df = spark.createDataFrame([(*e.values(), k) for k, e in enumerate(log)], "action_id string, mode string, image_id bigint, left bigint, right bigint, gesture string, winner bigint, undo_of string, at bigint")
    scores, hidden, _ = review.fold(log)
    got = {r.image_id: (round(r.score, 9), r.hidden) for r in review.review_state(df).collect() if r.score is not None}
    assert got == {i: (round(s, 9), hidden.get(i, False)) for i, s in scores.items()}


def test_swipe_fold_clamps_each_step(spark):
    rng = random.Random(1)
    data, want = [], {}
    for image in range(5):
        x = 50.0
        for k in range(80):
            g = rng.choice(["left", "right", "up", "down"])
            data.append((image, g, f"2024-01-{1 + k // 10:02} 00:00:{k % 60:02}", k))
            x = max(0.0, min(100.0, x + {"left": -10, "right": 10, "up": 5, "down": 0}[g]))
        want[image] = x
    df = spark.createDataFrame(data, "image_id bigint, gesture string, at string, seq bigint").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.image_id: r.score for r in review.swipe_scores(df).collect()} == want


def test_contained_prefers_the_equal_graph(spark):
    g = spark.createDataFrame([("w", ["A", "B"], ["A->B"]), ("none", ["Z"], ["Z->Z"]), ("bare", ["A"], [])], "workflow_key string, t array<string>, e array<string>")
    t = spark.createDataFrame([(1, "a", ["A", "B", "C"], ["A->B", "B->C"]), (2, "z", ["A", "B"], ["A->B"])], "template_id bigint, name string, t array<string>, e array<string>")
    assert rows(graphs.contained(g, t)) == [("w", 2, 1.0)]


def test_archive_plan_numbers_equal_names(spark):
    df = spark.createDataFrame([(1, "/a/x.png", "x.png", "m/1"), (2, "/b/x.png", "x.png", "m/1"), (3, "/c/y.png", "y.png", "")], "id bigint, abs_path string, filename string, checkpoint string")
    assert [r.name for r in export.archive_plan(df).orderBy("id").collect()] == ["x.png", "x_1.png", "y.png"]
    odd = spark.createDataFrame([(1, "", "x.png", ""), (2, "", "x.png", ""), (3, "", "x_1.png", ""), (4, "", "x.png", ""), (5, "", "x_1.png", "")], df.schema)
    taken = spark.createDataFrame([("", "x_3.png"), ("", "x_1_1.png")], "folder string, filename string")
    assert [r.name for r in export.archive_plan(odd).orderBy("id").collect()] == ["x.png", "x_2.png", "x_1.png", "x_3.png", "x_1_1.png"]
    assert [r.name for r in export.archive_plan(odd, taken=taken).orderBy("id").collect()] == ["x.png", "x_2.png", "x_1.png", "x_4.png", "x_1_2.png"]
    assert [r.folder for r in export.archive_plan(df, "checkpoint").orderBy("id").collect()] == ["m1", "m1", "unknown"]


def test_top_half_and_neighbours(spark):
    df = spark.createDataFrame([(1, "g", 10.0, False), (2, "g", 20.0, False), (3, "g", None, False), (4, "g", 99.0, True)], "id bigint, g string, score double, hidden boolean")
    assert [r.id for r in ranking.top_half(df, "g").orderBy("rank").collect()] == [2, 1]
    n = ranking.neighbours(spark.createDataFrame([("a", 3), ("b", 5)], "group_key string, count bigint")).orderBy("position").collect()
    assert [(r.group_key, r.previous, r.next) for r in n] == [("b", None, "a"), ("a", "b", None)]


def test_drawn_pairs_follow_the_weights(spark):
    pairs = spark.createDataFrame([(1, 2, 9.0), (3, 4, 1.0)], "a bigint, b bigint, weight double")
    hits = sum(ranking.draw_pairs(pairs, seed).first().a == 1 for seed in range(60))
    assert 45 <= hits <= 60


def test_outliers_of_a_group(spark):
    df = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [1.0, 0.0]), (3, "g", [0.0, 1.0]), (4, "h", [0.0, 1.0])], "id bigint, group_key string, vec array<float>")
    assert rows(similarity.outliers(df, "g", 0.75)) == [(3, "g", 0.0, "h", 1.0)]


def test_average_linkage_in_a_task_and_in_rounds_agree(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 70)] + 0.6 * rng.normal(size=(70, 8))
    x[40:44] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"b{i % 2}", i, v.tolist()) for i, v in enumerate(x)], "bucket string, id bigint, vec array<double>")
    for t in (0.5, 0.75):
        whole = {r.id: r.cluster for r in clustering.average_linkage(df, t).collect()}
        assert whole == {r.id: r.cluster for r in clustering.average_linkage(df, t, fits=8).collect()}
        assert 2 < len(set(whole.values())) < 70

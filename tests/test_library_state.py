"""Labels over time, drawn pairs, name order, payloads and backfills against plain rules."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import json_clean
from tessera.operators import backfill, ranking, review

LOG = "action_id string, image_id bigint, label_id bigint, op string, undo_of string, at bigint"


def _fold(log):
    """State of every (image, label) after each action, undos included, one action after another."""
    state, taken, undone, after = collections.defaultdict(bool), {}, set(), {}
    for action, image, label, op, undo_of, _ in sorted(log, key=lambda r: (r[5], r[0])):
        if op == "undo":
            if undo_of in taken and undo_of not in undone:
                undone.add(undo_of)
                key, was_new = taken[undo_of]
                if was_new:
                    state[key] = False
        else:
            key = (image, label)
            if op == "attach":
                taken[action] = (key, not state[key])
            state[key] = {"attach": True, "detach": False, "toggle": not state[key]}[op]
        after[action] = {k for k, on in state.items() if on}
    return after


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_with_undo_match_a_fold(spark, seed):
    rng = random.Random(seed)
    log = []
    for i in range(160):
        op = rng.choice(["attach", "attach", "toggle", "detach", "undo", "undo"])
        if op == "undo":
            past = [r for r in log if r[3] == "attach"]
            log.append((f"a{i:03}", None, None, "undo", rng.choice(past)[0] if past else "none", i // 2))
        else:
            log.append((f"a{i:03}", rng.randrange(4), rng.randrange(2), op, None, i // 2))
    expected = _fold(log)
    plain = review.with_undone(spark.createDataFrame(log, LOG))
    points = spark.createDataFrame([(image, at, a) for a, _, _, _, _, at in log for image in range(4)], "image_id bigint, at bigint, action_id string")
    for r in review.labels_at(points, review.label_intervals(plain)).collect():
        assert r.labels == sorted(label for image, label in expected[r.action_id] if image == r.image_id), r


def test_drawn_pairs_follow_their_weights(spark):
    """Chi-square of 4,000 draws a group against the weights of all pairs."""
    rng = random.Random(4)
    rows = [(g, 100 * g + i, None if i % 6 == 0 else rng.uniform(20, 80), rng.random()) for g in (1, 2) for i in range(12)] + [(3, 300, 50.0, 0.1), (4, None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "group_key bigint, id bigint, score double, staleness double")
    recent = spark.createDataFrame([(101, 100), (105, 107), (200, 203)], "a bigint, b bigint")
    n = 4000
    drawn = ranking.arena_draw(df, n, seed=3, recent=recent).groupBy("group_key", "a", "b").count().collect()
    weights = {(r.group_key, r.a, r.b): r.weight for r in ranking.arena_pairs(df.where("id is not null"), recent).collect()}
    for g in (1, 2):
        total = sum(w for k, w in weights.items() if k[0] == g)
        seen = {(r.group_key, r.a, r.b): r["count"] for r in drawn if r.group_key == g}
        assert sum(seen.values()) == n and seen.keys() <= weights.keys()
        chi = sum((seen.get(k, 0) - n * w / total) ** 2 / (n * w / total) for k, w in weights.items() if k[0] == g)
        assert chi < 110  # 65 degrees of freedom: 99.95 %
    assert not [r for r in drawn if r.group_key > 2]
    assert ranking.arena_draw(df.where("false"), 3, seed=1).count() == 0


def test_names_sort_as_a_chinese_reader_sorts_them(spark):
    names = ["img10.png", "Img2.png", "img1.png", "啊.png", "中文.png", "北京.png", "b.png", "A.png", "a.png", "上海2.png", "上海10.png", "_x.png", "01.png"]
    rows = [(i, n, 0, None, 1, 1) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id bigint, filename string, seed bigint, score double, size bigint, modified_at bigint")
    got = [r.filename for r in ranking.browse(df, "filename").collect()]
    # the locale's own rules: marks, digits, Han characters by pinyin, then Latin letters, small ones first
    assert got == ["_x.png", "01.png", "啊.png", "北京.png", "上海2.png", "上海10.png", "中文.png", "a.png", "A.png", "b.png", "img1.png", "Img2.png", "img10.png"]
    placed = ranking.places(df, "filename").orderBy("place").collect()
    assert [r.filename for r in placed] == got


def test_sensitive_keys_without_python(spark):
    def plain(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return False

        def deep(v):
            if isinstance(v, dict):
                return any("prompt" in k.lower() or "path" in k.lower() or deep(x) for k, x in v.items())
            return isinstance(v, list) and any(map(deep, v))

        return deep(value)

    texts = [
        '{"a": 1}', '{"a": [{"filePath": 1}]}', '{"x": "path"}', '{"x": "the \\"path\\": here"}', '{"\\u0070rompt": 1}', "no json", None, "", "[]", '"prompt"', '{"x": ["path", "prompt:"]}',
        '{"a": {"b": {"c": [[{"PROMPT_x": null}]]}}}', '{"k\\\\": "path", "v": 1}', '{"k\\"path": 2}', '{"x": ":", "path ": 1}', '{"x":"' + 'y\\n' * 3000 + '"}', '{"x": "a\\\\", "path": "b"}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    found = df.select("p", json_clean.has_sensitive_key(F.col("p")).alias("hit"))
    assert {r.p: r.hit for r in found.collect()} == {t: plain(t) for t in texts}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_payload_fields_by_their_kinds(spark):
    payloads = [
        '{"duration_ms": 2.5, "gesture": "up", "has_label": true, "image_id": 7, "path": "/x"}', '{"duration_ms": "2", "gesture": "UP", "has_label": 1, "image_id": null}',
        '{"duration_ms": -3, "image_id": "seven"}', "nothing", None,
    ]
    df = spark.createDataFrame([("swipe", p) for p in payloads] + [("other", "{}")], "event_name string, payload string")
    out = json_clean.sanitized(df, {"swipe": ["gesture", "has_label", "duration_ms", "image_id"]}, {"gesture": ["up"]}, ["duration_ms"], ["has_label"], "salt")
    h = lambda v: f"h_{json_clean.fnv1a(f'salt:{v}'):08x}"
    got = [json.loads(r.payload) for r in out.collect()]
    assert got == [{"duration_ms": 3, "gesture": "up", "has_label": True, "image_id": h(7)}, {}, {"duration_ms": 0, "image_id": h("seven")}, {}, {}]


def test_backfills_are_made_once(spark):
    sources = spark.createDataFrame([(3, "C:\\lib\\"), (1, "c:/lib"), (2, "/other")], "id bigint, path string")
    images = spark.createDataFrame([(10, 3, "C:\\lib\\a.png", "x"), (11, 1, "c:/lib/a.png", "y"), (12, 2, "/other/a.png", "z")], "id bigint, source_id bigint, abs_path string, group_key_l0 string")
    labels = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "image_id bigint, label_id bigint")
    bindings = spark.createDataFrame([(2, 11, "theirs"), (2, 10, "own"), (1, 11, "only"), (0, 12, "z")], "level int, image_id bigint, group_key string")
    tables = {"sources": sources, "images": images, "image_labels": labels, "manual_group_bindings": bindings}
    once = backfill.normalized_library(tables)
    shown = {n: sorted(map(tuple, t.collect())) for n, t in once.items()}
    assert shown["sources"] == [(1, "c:/lib"), (2, "/other")]
    assert [r[:3] for r in shown["images"]] == [(10, 1, "c:/lib/a.png"), (12, 2, "/other/a.png")]
    assert shown["image_labels"] == [(10, 1), (10, 2)]
    keys = {r[0]: r[3] for r in shown["images"]}
    assert shown["manual_group_bindings"] == sorted([(0, 12, keys[12]), (1, 10, "only"), (2, 10, "own")])
    twice = backfill.normalized_library(once)
    assert {n: sorted(map(tuple, t.collect())) for n, t in twice.items()} == shown


def test_archive_copies_and_log(spark, tmp_path):
    from tessera.operators import export
    from tessera.sources.folder_source import folder_listing
    from tessera.store import table_of

    (tmp_path / "in" / "x").mkdir(parents=True)
    for name, data in (("a.png", b"one"), ("x/a.png", b"two"), ("c", b"three")):
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c").write_bytes(b"old")
    rows = [(1, f"{tmp_path}/in/a.png", "a.png"), (2, f"{tmp_path}/in/x/a.png", "a.png"), (3, f"file:{tmp_path}/in/c", "c"), (4, f"{tmp_path}/in/gone.png", "gone.png")]
    images = spark.createDataFrame(rows, "id bigint, abs_path string, filename string")
    taken = folder_listing(spark, str(tmp_path / "out"), depth=0, suffixes="*").select(F.lit("").alias("folder"), F.col("name").alias("filename"))
    done = table_of(export.copy_files(export.archive_plan(images, taken=taken), f"{tmp_path}/out/"))
    assert {(r.image_id, r.dest_path.rsplit("/", 1)[1]) for r in done.collect()} == {(1, "a.png"), (2, "a_1.png"), (3, "c_1")}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"c": b"old", "a.png": b"one", "a_1.png": b"two", "c_1": b"three"}
    older = spark.createDataFrame([(1, "/before", None), (9, "/other", None)], done.schema)
    log = {r.image_id: r.dest_path for r in export.logged(older, done).collect()}
    assert log[9] == "/other" and log[1].endswith("out/a.png") and len(log) == 4


def test_merges_stay_in_their_source(spark):
    from tessera.operators import clustering

    images = spark.createDataFrame([(1, 1, "k", "p"), (2, 2, "k", "q"), (3, 1, "j", "r")], "id bigint, source_id bigint, group_key_l2 string, prompt_pos string")
    assert {r.image_id for r in clustering.merge_groups(images, ["k", "j"], source_id=1).collect()} == {1, 3}
    with pytest.raises(ValueError):
        clustering.merge_groups(images, ["k"], level=1)

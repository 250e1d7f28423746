"""Folder syncs: insert, rename, delete, ambiguity, templates."""

import json

from pyspark.sql import functions as F

from tessera.sources import files
from tessera.store import Store
from tessera.streaming.ingest import Poller, Synced, recluster_touched, refresh_templates, sync_source
from tests.test_sources import GRAPH, png


def graph(prompt, seed):
    g = json.loads(json.dumps(GRAPH))
    g["6"]["inputs"]["value"], g["4"]["inputs"]["seed"] = prompt, seed
    return png(prompt=json.dumps(g))


def test_sync_keeps_identity_through_renames(spark, tmp_path):
    root, lib = tmp_path / "images", tmp_path / "lib"
    root.mkdir()
    (root / "a.png").write_bytes(graph("a cat, sitting", 1))
    (root / "b.png").write_bytes(graph("a cat, standing", 2))
    store = Store(spark, str(lib))
    done = sync_source(store, 1, str(root), wait=False)
    assert (done.new, done.renamed, done.removed) == (2, 0, 0)
    first = {r.filename: r for r in store.read("images").collect()}
    assert first["a.png"].prompt_pos == "a cat, sitting" and first["a.png"].recipe_signature
    assert first["a.png"].group_key_l2 == first["b.png"].group_key_l2 != first["a.png"].group_key_l1
    store.upsert("scores", spark.createDataFrame([(first["a.png"].id, 80.0)], "image_id bigint, internal_score double"))
    (root / "a.png").rename(root / "c.png")
    (root / "b.png").unlink()
    done = sync_source(store, 1, str(root), wait=False)
    assert (done.new, done.renamed, done.removed) == (0, 1, 1)
    (row,) = store.read("images").collect()
    assert row.id == first["a.png"].id and row.filename == "c.png"
    assert [r.internal_score for r in store.read("scores").collect()] == [80.0]
    (root / "d.png").write_bytes(graph("new", 3))
    done = sync_source(store, 1, str(root))
    assert (done.new, done.pending) == (0, 1)


def test_failed_and_unfingerprinted_rows_are_read_again(spark, tmp_path):
    root = tmp_path / "images"
    root.mkdir()
    for name, prompt, seed in (("a.png", "a cat", 1), ("b.png", "a dog", 2), ("c.png", "a fox", 3)):
        (root / name).write_bytes(graph(prompt, seed))
    store = Store(spark, str(tmp_path / "lib"))
    sync_source(store, 1, str(root), wait=False)
    assert sync_source(store, 1, str(root), wait=False).again == 0
    first = {r.filename: r for r in store.read("images").collect()}
    broken = [(first["a.png"].id, False, "lost", first["a.png"].content_fp), (first["b.png"].id, True, "a dog", "")]
    store.update("images", spark.createDataFrame(broken, "id bigint, meta_ok boolean, prompt_pos string, content_fp string"))
    done = sync_source(store, 1, str(root), wait=False)
    assert (done.new, done.renamed, done.removed, done.again) == (0, 0, 0, 2)
    after = {r.filename: r for r in store.read("images").collect()}
    assert after == first


def test_touched_buckets_follow_the_stored_mode(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"))
    images = [(1, "x", "x", "a b c"), (2, "x", "x", "d e f"), (3, "x", "x", "a b c"), (4, "y", "old", "a b c")]
    store.append("images", spark.createDataFrame(images, "id bigint, group_key_l1 string, group_key_l2 string, prompt_pos string"))
    store.append("sources", spark.createDataFrame([(5, "/p", "visual", 0.9)], "id bigint, path string, l2_mode string, l2_visual_threshold double"))
    vectors = [(i, "vision", "clip-vit-b32-q", v) for i, v in ((1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]))]
    store.append("image_signatures", spark.createDataFrame(vectors, "image_id bigint, slot string, model_id string, vec array<float>"))
    touched = spark.createDataFrame([("x",)], "group_key_l1 string")
    key = lambda: {r.id: r.group_key_l2 for r in store.read("images").collect()}
    recluster_touched(store, touched, 5)
    seen = key()
    assert seen[1] == seen[2] != seen[3] and seen[4] == "old"
    recluster_touched(store, touched)
    text = key()
    assert text[1] == text[3] != text[2] and text[4] == "old"


def test_templates_are_matched(spark, tmp_path):
    root = tmp_path / "images"
    root.mkdir()
    (root / "a.png").write_bytes(graph("p", 1))
    store = Store(spark, str(tmp_path / "lib"))
    sync_source(store, 1, str(root), wait=False)
    g = store.read("images").first().workflow_graph
    kinds = sorted({*g.t})
    ui = {"nodes": [{"id": i, "type": t} for i, t in enumerate(kinds)], "links": [[0, kinds.index(e.split("->")[0]), 0, kinds.index(e.split("->")[1]), 0, "T"] for e in g.e]}
    (tmp_path / "flow.json").write_text(json.dumps(ui))
    refresh_templates(store, files.templates(spark, str(tmp_path / "flow.json")))
    row = store.read("images").select("workflow_template_id", "workflow_match_confidence").first()
    assert row.workflow_template_id == store.read("workflow_templates").first().id and row.workflow_match_confidence == 1.0
    assert store.read("images").where(F.col("workflow_template_id").isNull()).count() == 0


def test_ids_survive_renames_and_new_files_at_old_paths(spark, tmp_path):
    """Over three rounds every file has one row with an id of its own, and scores stay with their image."""
    root = tmp_path / "images"
    root.mkdir()
    store = Store(spark, str(tmp_path / "lib"))
    ids = {}
    for turn in range(3):
        if turn:
            (root / "a.png").rename(root / f"old{turn}.png")
        (root / "a.png").write_bytes(graph(f"a cat number {turn}", 10 + turn))
        sync_source(store, 1, str(root), wait=False)
        rows = store.read("images").collect()
        assert len(rows) == turn + 1 == len({r.id for r in rows}) == len({r.abs_path for r in rows})
        for r in rows:
            assert ids.setdefault(r.prompt_pos, r.id) == r.id
        new = ids[f"a cat number {turn}"]
        store.upsert("scores", spark.createDataFrame([(new, 60.0 + turn)], "image_id bigint, internal_score double"))
    joined = store.read("images").join(store.read("scores"), F.col("id") == F.col("image_id"))
    assert sorted((r.prompt_pos, r.internal_score) for r in joined.collect()) == [(f"a cat number {i}", 60.0 + i) for i in range(3)]
    for f in root.iterdir():
        f.unlink()
    (root / "b.png").write_bytes(graph("another", 99))
    sync_source(store, 1, str(root), wait=False)
    (row,) = store.read("images").collect()
    assert row.id not in ids.values() or row.id > max(ids.values())


def test_a_restarted_poller_parses_nothing_twice(spark, tmp_path):
    root, flows = tmp_path / "images", tmp_path / "user"
    (flows / "deep").mkdir(parents=True)
    root.mkdir()
    (root / "a.png").write_bytes(graph("a cat", 1))
    ui = {"nodes": [{"id": 1, "type": "KSampler"}], "links": [], "id": "w1"}
    (flows / "deep" / "flow.json").write_text(json.dumps(ui))
    store = Store(spark, str(tmp_path / "lib"))

    def run(settle=0.0):
        poller = Poller(store, 1, str(root), str(tmp_path / "checkpoint"), templates=str(flows), settle=settle)
        poller.start(once=True)
        return poller.passes

    first = run()
    assert sorted(str(p[1]) for p in first) == sorted(["templates", str(Synced(1, 0, 0, 0, 0))])
    assert store.read("workflow_templates").count() == 1
    assert run() == []  # a new poller at the same checkpoint: nothing has changed
    (root / "b.png").write_bytes(graph("a dog", 2))
    (root / "a.png").rename(root / "c.png")
    assert [p[1] for p in run()] == [Synced(1, 1, 0, 0, 0)]
    (root / "young.png").write_bytes(graph("young", 3))
    (root / "c.png").unlink()
    passes = [p[1] for p in run(settle=3600.0) if p[1] != "templates"]
    assert passes == [Synced(0, 0, 1, 1, 0)]  # nothing on disk is settled: the known file stays, the new one waits, the deleted one goes
    assert [r.filename for r in store.read("images").collect()] == ["b.png"] and store.read("workflow_templates").count() == 1

"""Parsers and file sources on files made here."""

import json
import time

from pyspark.sql import functions as F

from tessera.operators.embed import WordPiece, preprocess, resize_matrix, text_vectors
from tessera.schemas import select_with_defaults
from tessera.sources import files
from tessera.sources.metadata import PNG_MAGIC, from_graph, image_meta, parse_image, parse_parameters, png_chunk, png_chunks, rewrite_prompt
from tessera.sources.node_graph import loras_of, topology
from tessera.store import Store


def png(**texts):
    head = PNG_MAGIC + png_chunk(b"IHDR", (8).to_bytes(4, "big") + (6).to_bytes(4, "big") + b"\x08\x02\0\0\0")
    return head + b"".join(png_chunk(b"tEXt", k.encode() + b"\0" + v.encode()) for k, v in texts.items()) + png_chunk(b"IDAT", b"z") + png_chunk(b"IEND", b"")


GRAPH = {
    "1": {"class_type": "CheckpointLoaderSimple", "inputs": {"ckpt_name": "m.safetensors"}},
    "2": {"class_type": "CLIPTextEncode", "inputs": {"text": ["5", 0], "clip": ["1", 1]}},
    "3": {"class_type": "CLIPTextEncode", "inputs": {"text": "bad", "clip": ["1", 1]}},
    "4": {"class_type": "KSampler", "inputs": {"positive": ["2", 0], "negative": ["3", 0], "seed": 7, "steps": 20, "cfg": 5, "sampler_name": "euler", "scheduler": "normal"}},
    "5": {"class_type": "TextSwitch", "inputs": {"switch": True, "on_true": ["6", 0], "on_false": "no"}},
    "6": {"class_type": "Note", "inputs": {"value": "a cat"}},
}


def test_graph_follows_switches_and_links():
    m = from_graph(json.dumps(GRAPH)[:-1] + ', "7": {"class_type": "X", "inputs": {"v": NaN}}}')
    assert (m["prompt_pos"], m["prompt_neg"], m["checkpoint"], m["samplers"][0]["seed"]) == ("a cat", "bad", "m.safetensors", 7)
    assert not from_graph("no json")["meta_ok"]


def test_zeroed_negative_and_loose_prompt():
    g = json.loads(json.dumps(GRAPH))
    g["3"] = {"class_type": "ConditioningZeroOut", "inputs": {"conditioning": ["2", 0]}}
    assert from_graph(json.dumps(g))["prompt_neg"] == ""
    del g["4"]
    assert from_graph(json.dumps(g))["prompt_pos"] == "a cat"


def test_topology_is_alike_in_both_forms():
    api = {"1": {"class_type": "A", "inputs": {}}, "2": {"class_type": "B", "inputs": {"x": ["1", 0], "y": "1"}}}
    ui = {"nodes": [{"id": 1, "type": "A"}, {"id": 2, "type": "B"}], "links": [[9, 1, 0, 2, 0, "T"]]}
    assert topology(api) == topology(ui) == (["A", "B"], ["A->B"])


def test_custom_lora_slots():
    assert loras_of({"lora_1": "a.safetensors", "lora_1_strength": "0.5"}) == [{"name": "a.safetensors", "strength": 0.5, "clip_strength": None}]
    slot = {"on": True, "lora": "b", "strength": 0.7, "strengthTwo": 0.2}
    assert loras_of({"x": slot, "y": slot | {"on": False}}) == [{"name": "b", "strength": 0.7, "clip_strength": 0.2}]
    assert [x["name"] for x in loras_of({"loras": {"__value__": [{"name": "c", "active": False}, {"name": "d", "strength": 1}]}})] == ["d"]


def parsed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", parse_parameters("text").alias("m"))
    found = [r.m.asDict(True) for r in rows.orderBy("id").collect()]
    return found[0] if len(texts) == 1 else found


def test_parameter_text(spark):
    m = parsed(spark, "a cat\nsecond\nNegative prompt: ugly\nSteps: 20, Sampler: Euler a, CFG scale: 7, Seed: 5, Size: 512x768, Model: m, Lora hashes: \"x: 1\"")
    assert (m["prompt_pos"], m["prompt_neg"], m["width"], m["height"], m["checkpoint"]) == ("a cat\nsecond", "ugly", 512, 768, "m")
    assert m["samplers"][0]["sampler"] == "Euler a" and m["loras"][0]["name"] == "x"


def plain_settings(text):
    """The settings of a parameter text by a plain loop."""
    rows = text.split("\n")
    k = next((i for i, row in enumerate(rows) if row.startswith("Steps:")), None)
    said = {}
    for part in rows[k].split(", ") if k is not None else ():
        name, found, value = part.partition(": ")
        if found:
            said[name.strip()] = value.strip()
    return k, said


HARD = [
    None, "", "Steps: 5", "only a prompt", "a\n  Negative prompt:  b\nNegative prompt: c\nmore", "Negative prompt: x\nSteps: 3, Seed: no, CFG scale: 1e1",
    "a\u3000\nSteps: 7, Seed: 1, Seed: 2, Model: a: b, Sampler:  DPM , Schedule type: Karras\nVersion: 1, Model: z",
    "p\r\nSteps: 9, Size: 64x, Width: 0, Height: 12, Seed: 99999999999999999999", "p, Steps: 1\nsteps: 2", "p\nSteps: 4, CFG scale: x, Scheduler: A, Schedule type: B, VAE: v",
    'q\nSteps: 1, Lora hashes: "a: 1, b: 2", TI hashes: "t: 1,u,t : 2,"', "\u00a0tab\t \nSteps: +6, Size: 5x7x9, Seed: -4", "x" * 200000 + " " * 200000 + "y\nSteps: 2",
]


def test_parameter_texts_match_a_plain_loop(spark):
    for text, m in zip(HARD, parsed(spark, *HARD)):
        k, said = plain_settings(text or "")
        head = "\n".join((text or "").split("\n")[:k])
        at = next((i for i, row in enumerate(head.split("\n")) if row.lstrip(" \t").startswith("Negative prompt:")), None)
        lines = head.split("\n")
        positive = head if at is None else "\n".join(lines[:at])
        negative = "" if at is None else "\n".join([lines[at].lstrip(" \t")[16:], *lines[at + 1 :]])
        assert (m["prompt_pos"], m["prompt_neg"]) == (positive.strip(), negative.strip())
        assert (m["checkpoint"], m["vae"], m["meta_ok"], m["source_kind"]) == (said.get("Model", ""), said.get("VAE", ""), True, "a1111")
        assert len(m["samplers"]) == (k is not None)
        if k is not None:
            s = m["samplers"][0]
            assert (s["sampler"], s["scheduler"]) == (said.get("Sampler", ""), said.get("Scheduler", said.get("Schedule type", "")))
            assert s["steps"] == int(said.get("Steps", 0))
    by = dict(zip(HARD, parsed(spark, *HARD)))
    numbers = lambda text: (by[text]["samplers"][0]["seed"], by[text]["samplers"][0]["cfg"], by[text]["width"], by[text]["height"])
    assert [numbers(HARD[i]) for i in (5, 6, 7, 11)] == [(0, 10.0, 0, 0), (2, 0.0, 0, 0), (0, 0.0, 64, 12), (-4, 0.0, 5, 0)]
    assert [x["name"] for x in by[HARD[10]]["loras"]] == ["a"] and by[HARD[10]]["embeddings"] == ["t", "u"]


def test_parameter_text_needs_no_python_and_reaches_images(spark):
    rows = spark.createDataFrame([("p\nSteps: 1, Size: 5x9, Seed: 3",)], "text string").select(parse_parameters("text").alias("m"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    data = [("a.png", png(parameters="p\nSteps: 1, Size: 5x9, Seed: 3")), ("b.png", png()), ("c.jpg", b"\xff\xd8ASCII\0\0\0p\nSteps: 1, Size: 5x9\0"), ("d.png", None)]
    m = {r.path: r.m for r in spark.createDataFrame(data, "path string, content binary").select("path", parse_image("path", "content").alias("m")).collect()}
    assert [(m[p].prompt_pos, m[p].width, m[p].height, m[p].meta_ok) for p in sorted(m)] == [("p", 8, 6, True), ("", 8, 6, False), ("p", 5, 9, True), ("", 0, 0, False)]
    assert m["a.png"].samplers[0].seed == 3 and m["a.png"].source_kind == "a1111"


def test_png_and_rewrite():
    data = png(prompt=json.dumps({**GRAPH, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "old"}}}))
    new = rewrite_prompt(data, "new one", "none")
    m = image_meta("a.png", new)
    assert (m["prompt_pos"], m["prompt_neg"], m["width"], m["height"]) == ("new one", "none", 8, 6)
    assert [c[:2] for c in png_chunks(new) if c[0] != b"tEXt"] == [c[:2] for c in png_chunks(data) if c[0] != b"tEXt"]
    assert rewrite_prompt(png(prompt=json.dumps(GRAPH)), "x", "y") is None
    assert rewrite_prompt(png(), "x", "y") is None and image_meta("b.png", b"junk")["meta_ok"] is False


def test_folder_scan_companions_and_templates(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    begun = F.timestamp_seconds(F.lit(int(time.time())))
    (tmp_path / "a.PNG").write_bytes(png(parameters="p\nSteps: 1, Seed: 3"))
    (tmp_path / "sub" / "b.png").write_bytes(png())
    (tmp_path / "sub" / "deep" / "c.png").write_bytes(png())
    (tmp_path / "sub" / "b.txt").write_text("from text Negative prompt: none")
    (tmp_path / "t.json").write_text(json.dumps({"nodes": [{"id": 1, "type": "UNETLoader", "widgets_values": ["m"]}, {"id": 2, "type": "B"}], "links": [[9, 1, 0, 2, 0, "T"]]}))
    found = files.with_companion(files.parsed_images(spark, str(tmp_path)), files.companions(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[-1]: (r.meta.prompt_pos, r.meta.prompt_neg) for r in found.collect()}
    assert got == {"a.PNG": ("p", ""), "b.png": ("from text", "none")}
    t = files.templates(spark, str(tmp_path)).first()
    assert (t.name, t.t, t.e, t.node_count, t.diffusion_models) == ("t", ["B", "UNETLoader"], ["UNETLoader->B"], 2, ["m"])
    ready, pending = files.stable(files.binary_files(spark, str(tmp_path)), begun)  # however slow the steps above
    assert ready.count() == 0 and pending.count() == 2


def test_store_upsert_update_and_cascade(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("images", spark.createDataFrame([(1, 1, "/a", "k"), (2, 1, "/b", "k")], "id bigint, source_id bigint, abs_path string, group_key_l2 string"))
    store.upsert("scores", spark.createDataFrame([(1, 60.0), (2, 40.0)], "image_id bigint, internal_score double"))
    store.upsert("scores", spark.createDataFrame([(1, 70.0)], "image_id bigint, internal_score double"))
    store.update("images", spark.createDataFrame([(2, "/c")], "id bigint, abs_path string"))
    assert store.hide("group_key_l2", "k") == 2 and store.hide("group_key_l2", "k") == 0
    gone = store.delete_missing(1, spark.createDataFrame([("/c",)], "norm_path string"))
    assert [r.id for r in gone.collect()] == [1]
    assert [(r.image_id, r.internal_score) for r in store.read("scores").collect()] == [(2, 40.0)]


def test_older_libraries_take_defaults(spark):
    row = select_with_defaults(spark.createDataFrame([(1, None)], "id bigint, seed bigint"), "images").first()
    assert (row.id, row.seed, row.prompt_pos, row.hidden) == (1, 0, "", False)


def test_wordpiece():
    vocab = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "cat", "##s", "红", ",", "a"])}
    t = WordPiece(vocab)
    assert t.encode("A cats红, dog\u0000") == [2, 8, 4, 5, 6, 7, 1, 3]
    assert t.pieces("a" * 101) == [1] and len(WordPiece(vocab, cap=4).encode("a a a a a")) == 4
    out = text_vectors(["a", "cats a"], t, lambda ids, mask: (ids * mask)[..., None].astype(float).repeat(2, axis=2))
    assert out.shape == (2, 2) and abs((out**2).sum(axis=1) - 1).max() < 1e-9


def test_image_preprocessing_keeps_flat_colour():
    import numpy as np

    x = preprocess(np.full((30, 40, 3), 128, np.uint8), crop=16)
    assert x.shape == (3, 16, 16) and np.ptp(x, axis=(1, 2)).max() < 1e-6
    assert abs(resize_matrix(40, 21).sum(axis=1) - 1).max() < 1e-12

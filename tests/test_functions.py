"""Scalar functions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys, scores, text, vectors
from tessera.functions.json_clean import clean_json, fnv1a, has_sensitive_key


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("prompt,want", [
    ("A Cat,  Dog", ["a", "cat", "dog"]),
    ("abc红d 1girl", ["abc", "红", "d", "1girl"]),
    ("(best:1.2), x", ["(best:1.2)", "x"]),
    ("", []),
])
def test_prompt_tokens(spark, prompt, want):
    assert one(spark, text.prompt_tokens(F.col("p")), p=prompt) == want


def test_jaccard_of_empty_sets_is_one(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty)) == 1.0
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)


def test_embedding_refs(spark):
    p = "x, embedding:EasyNeg., (Embedding:bad hand:1.2) noembedding:z"
    assert one(spark, text.embedding_refs(F.col("p")), p=p) == ["EasyNeg", "bad hand:1.2"]
    assert one(spark, text.embedding_refs(F.col("p")), p="nothing") == []


@pytest.mark.parametrize("path,want", [("\\\\?\\C:\\a\\b\\", "c:/a/b"), ("/x/y/", "/x/y"), ("/", "/")])
def test_normalize_path(spark, path, want):
    assert one(spark, text.normalize_path(F.col("p")), p=path) == want


def test_natural_key_orders_numbers(spark):
    names = ["img10.png", "img2.png", "img1.png"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["img1.png", "img2.png", "img10.png"]


def test_csv_and_names(spark):
    assert one(spark, text.csv_field(F.col("p")), p='a "b", c') == '"a ""b"", c"'
    assert one(spark, text.sanitize_name(F.col("p")), p=" a/b c? ") == "ab_c"
    assert one(spark, text.compact_label(F.col("p")), p="x" * 41) == "x" * 40 + "…"
    assert one(spark, text.mask(F.col("p")), p="红a1,é") == "〇xx,x"


def test_lora_key_ignores_strength_and_order(spark):
    schema = "l array<struct<name: string, strength: double>>"
    rows = [([("b", 1.0), ("a", 0.5)],), ([("a", 0.1), ("b", 0.2), ("a", 0.3)],), ([("c", 1.0)],), ([],), (None,)]
    found = spark.createDataFrame(rows, schema).select(keys.key_l1("lora", keys.dimension_values("lora", {"loras": F.col("l")})).alias("k")).collect()
    k = [r.k for r in found]
    assert k[0] == k[1] != k[2] and k[3] == k[4] not in k[:3]


def test_hash_policies(spark):
    import xxhash

    assert one(spark, keys.hash16(F.col("p"), "xxh3"), p="abc") == xxhash.xxh3_64_hexdigest(b"abc")
    assert len(one(spark, keys.hash16(F.col("p")), p="abc")) == 16


def test_scores(spark):
    assert one(spark, scores.swiped(F.lit(95.0), F.lit("right"))) == 100.0
    assert one(spark, scores.clean(F.lit(float("nan")))) == 50.0
    win, lose = scores.arena(F.lit(50.0), F.lit(50.0), F.lit(True))
    assert (one(spark, win), one(spark, lose)) == (54.0, 46.0)
    assert one(spark, scores.close_match(F.lit(None).cast("double"), F.lit(54.9)))


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>")
    assert one(spark, vectors.normalize(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.dot(v, F.array(F.lit(1.0)))) == 3.0
    assert one(spark, vectors.decode_floats(F.col("b")), b=bytearray(b"\0\0\x80?")) == [1.0]
    assert one(spark, vectors.decode_floats(F.col("b")), b=bytearray(b"\0\0")) is None


def test_json(spark):
    assert clean_json('{"a": NaN, "b": "NaN", "c": [-Infinity]}') == '{"a": null, "b": "NaN", "c": [null]}'
    assert one(spark, has_sensitive_key(F.col("p")), p='{"a": [{"filePath": 1}]}')
    assert not one(spark, has_sensitive_key(F.col("p")), p="no json")
    assert fnv1a("") == 0x811C9DC5

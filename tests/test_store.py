"""Stored tables: changes against plain dictionaries, and which files a change touches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.store import Store, table_of

SCORE = "image_id bigint, internal_score double, last_mode string"


def held(store):
    return {r.image_id: (r.internal_score, r.last_mode) for r in store.read("scores").collect()}


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "lib"), buckets=8)
    store.overwrite("scores", spark.createDataFrame([(k, float(k), None) for k in range(200)], SCORE))
    return store


def test_a_change_writes_only_its_buckets(spark, store, tmp_path):
    before = files(tmp_path / "lib")
    store.upsert("scores", spark.createDataFrame([(7, 70.0, "swipe")], SCORE))
    after = files(tmp_path / "lib")
    changed = {str(Path(p).parent) for p in after.keys() ^ before.keys()}
    assert len(changed) == 1 and len({str(Path(p).parent) for p in after}) == 8
    assert held(store) == {k: (70.0, "swipe") if k == 7 else (float(k), None) for k in range(200)}


def test_append_leaves_all_files_as_they_were(spark, store, tmp_path):
    before = files(tmp_path / "lib")
    store.append("scores", spark.createDataFrame([(1000, 1.0, None)], SCORE))
    assert before.items() <= files(tmp_path / "lib").items() and held(store)[1000] == (1.0, None) and len(held(store)) == 201


def test_update_keeps_values_where_null_and_sets_null_on_request(spark, store):
    # narrower key types fall into the same bucket
    store.update("scores", spark.createDataFrame([(3, None, "arena"), (999, 5.0, "none")], "image_id int, internal_score double, last_mode string"))
    assert held(store)[3] == (3.0, "arena") and 999 not in held(store)
    store.update("scores", spark.createDataFrame([(3, None, None)], SCORE), nulls=("last_mode",))
    assert held(store)[3] == (3.0, None) and len(held(store)) == 200


def test_insert_absent_may_run_twice(spark, store):
    rows = spark.createDataFrame([(5, 0.0, "new"), (500, 0.0, "new")], SCORE)
    for _ in range(2):
        store.insert_absent("scores", rows)
    assert held(store)[5] == (5.0, None) and held(store)[500] == (0.0, "new") and len(held(store)) == 201


def test_emptied_buckets_lose_their_rows(spark, store):
    assert store.delete("scores", F.col("image_id") >= 0) == 200 and held(store) == {} and store.has("scores")
    assert store.delete("scores", "image_id > 3") == 0
    store.upsert("scores", spark.createDataFrame([(1, 2.0, None)], SCORE))
    assert held(store) == {1: (2.0, None)}


def test_other_keys_reach_every_bucket(spark, store):
    store.update("scores", spark.createDataFrame([("x", 1.0)], "last_mode string, internal_score double"), keys=["last_mode"])
    assert len(held(store)) == 200
    store.update("scores", spark.createDataFrame([(9, "x")], "image_id bigint, last_mode string"))
    store.upsert("scores", spark.createDataFrame([(9000, 4.0, "x")], SCORE), keys=["last_mode"])
    assert 9 not in held(store) and held(store)[9000] == (4.0, "x") and len(held(store)) == 200


def test_cascade_goes_through_all_tables_and_may_run_again(spark, store):
    store.overwrite("images", spark.range(200).withColumn("source_id", F.lit(1)).withColumn("abs_path", F.col("id").cast("string")))
    store.append("image_labels", spark.createDataFrame([(4, 1), (5, 1)], "image_id bigint, label_id bigint"))
    listing = spark.range(200).where("id <> 4").select(F.col("id").cast("string").alias("norm_path"))
    for left in (1, 0):
        assert store.delete_missing(1, listing).count() == left
    assert store.read("images").count() == 199 and 4 not in held(store)
    assert [r.image_id for r in store.read("image_labels").collect()] == [5]


def test_a_failed_change_leaves_the_table(spark, store):
    bad = table_of(spark.range(5)).select(F.col("id").alias("image_id"), F.raise_error(F.lit("lost")).cast("double").alias("internal_score"))
    before = held(store)
    with pytest.raises(Exception, match="lost"):
        store.overwrite("scores", bad)
    assert held(store) == before


def test_tables_never_written_are_empty(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert not store.has("labels") and store.read("labels").count() == 0
    store.delete_label(1)
    store.delete_images(spark.range(3))
    assert not store.has("labels")

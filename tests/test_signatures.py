"""Signature jobs: cancelled after a chunk, resumed, counted."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming.signatures import SignatureJob, candidates, hashed_words

IMAGES = "id bigint, prompt_pos string, abs_path string, hidden boolean, file_missing boolean"


@pytest.fixture(scope="module")
def images(spark):
    rows = [(i, f"word{i} and word{i % 7}", f"/p{i}", i % 5 == 0, i % 7 == 0) for i in range(60)]
    return spark.createDataFrame([*rows, (60, " ", "/e", False, False), (61, None, "/n", None, None), (62, ",,,", "/c", False, False), (3, "again", "/p3", False, False)], IMAGES)


def test_cancel_and_resume(spark, images, tmp_path):
    seen, folder = [], str(tmp_path / "job")

    def tower(rows):
        seen.append(sorted(r.image_id for r in rows.select("image_id").collect()))
        if len(seen) == 2:  # as if a user cancelled while the second chunk runs
            job.cancelled = True
            raise RuntimeError("interrupted")
        return hashed_words()(rows)

    job = SignatureJob(spark, folder, "text", "m", tower)
    computed = spark.createDataFrame([(0, "text", "m"), (1, "text", "other"), (2, "vision", "m")], "image_id bigint, slot string, model_id string")
    assert job.plan(images, computed, chunk=16) == 60  # 60 with a prompt and one of commas, less the computed one
    job.start()
    stopped = job.wait()
    assert stopped.cancelled and not stopped.finished and stopped.done == len(seen[0]) > 0
    job = SignatureJob(spark, folder, "text", "m", tower)
    assert job.plan(images, computed, chunk=5) == 60  # the same plan
    job.start()
    end = job.wait()
    assert (end.total, end.done, end.failed, end.finished) == (60, 59, 1, True)
    assert seen[2] == seen[1] and sorted(i for s in [seen[0], *seen[2:]] for i in s) == sorted({*range(1, 60), 62})
    rows = job.rows().collect()
    assert len(rows) == len({r.image_id for r in rows}) == 60
    job.start()
    before = len(seen)
    assert job.wait().done == 59 and len(seen) == before  # nothing is left


def test_candidates_and_force(spark, images, tmp_path):
    assert {r.id for r in candidates(images, "vision").collect()} == {i for i in range(60) if i % 5 and i % 7} | {60, 61, 62}
    computed = images.select(F.col("id").alias("image_id"), F.lit("text").alias("slot"), F.lit("m").alias("model_id"))
    none = SignatureJob(spark, str(tmp_path / "none"), "text", "m", hashed_words())
    assert none.plan(images, computed) == 0 and none.start() is None and none.wait().finished
    forced = SignatureJob(spark, str(tmp_path / "forced"), "text", "m", hashed_words())
    assert forced.plan(images, computed, chunk=100, force=True) == 61
    forced.start()
    assert forced.wait().finished
    vectors = {r.image_id: r.vec for r in forced.rows().where("vec is not null").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in vectors.values())


def test_one_job_a_tower(spark, images, tmp_path):
    def slow(rows):
        time.sleep(3)
        return hashed_words()(rows)

    first = SignatureJob(spark, str(tmp_path / "a"), "text", "one", slow)
    first.plan(images, chunk=100)
    first.start()
    other = SignatureJob(spark, str(tmp_path / "b"), "text", "one", slow)
    other.plan(images, chunk=100)
    with pytest.raises(RuntimeError, match="running"):
        other.start()
    assert first.wait().finished
    other.start()
    assert other.wait().finished and other.progress.chunks <= 1

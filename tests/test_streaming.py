"""Stateful folds and event-time windows over files that come in turns."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.review import swipe_scores
from tessera.sources.folder_source import folder_listing
from tessera.streaming import folds

SWIPES = "image_id bigint, gesture string, at timestamp, seq bigint"


def _swipe(image, gesture, minute, seq=0):
    return (image, gesture, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), seq)


def test_scores_go_on_after_a_restart(spark, tmp_path):
    """Two files, each in its own run of the stream; within the delay order does not matter, clamping does."""
    first = [_swipe(1, "right", m) for m in range(7)] + [_swipe(1, "left", 30), _swipe(2, "left", 20), _swipe(3, "down", 5), _swipe(None, "up", 1), _swipe(4, "nod", 1)]
    second = [_swipe(1, "right", 29), _swipe(1, "up", 31), _swipe(2, "right", 19), _swipe(2, "right", 19, 1), _swipe(5, "up", 400)]
    rows, check, source = str(tmp_path / "rows"), str(tmp_path / "check"), str(tmp_path / "in")
    for part in (first, second):
        spark.createDataFrame(part, SWIPES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SWIPES).parquet(source)
        folds.run_available(folds.streamed_scores(stream, "1 hour"), rows, check, mode="update")
    got = {r.image_id: r.score for r in folds.latest(spark, rows, folds.SCORES, "image_id").collect()}
    everything = spark.createDataFrame(first + second, SWIPES).where("image_id is not null")
    assert got == {r.image_id: r.score for r in swipe_scores(everything).collect()} and got[1] == 95.0
    before = spark.read.parquet(rows).count()
    folds.run_available(folds.streamed_scores(spark.readStream.schema(SWIPES).parquet(source), "1 hour"), rows, check, mode="update")
    assert spark.read.parquet(rows).count() == before  # no file is read again


def test_late_rows_are_dropped_and_windows_come_once(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double, user_id bigint"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [("a", at(5), 1.0, 1), ("a", at(130), 2.0, 1), ("a", at(125), 2.0, 2)]
    second = [("a", at(10), 9.0, 1), ("a", at(100), 9.0, 1), ("a", at(121), 4.0, 2), ("a", at(300), 1.0, 1)]  # the first two are too late for windows
    source = str(tmp_path / "in")
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        for name, made in (("w", folds.windowed), ("s", folds.sessions)):
            stream = spark.readStream.schema(schema).parquet(source)
            folds.run_available(made(stream), str(tmp_path / name), str(tmp_path / f"{name}-check"))
    windows = sorted((r.start, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "w")).collect())
    assert windows == [(at(0), 1, 1.0), (at(120), 3, 8.0)]
    sessions = sorted((r.user_id, r.start, r.end, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    # the row of minute 100 ends at 130, after the watermark (120): kept, and joins that of minute 130
    assert sessions == [(1, at(5), at(35), 1), (1, at(100), at(160), 2), (2, at(121), at(155), 2)]


def test_listings_by_folder(spark, tmp_path):
    for p in ("a.png", "b.JPG", "c.txt", "s/d.webp", "s/t/e.png", "s/t/u/f.png", "x y/g+h%20.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    root = str(tmp_path)
    names = lambda **o: sorted(r.name for r in folder_listing(spark, root, **o).collect())
    assert names(depth=0) == ["a.png", "b.JPG"]
    assert names() == ["a.png", "b.JPG", "d.webp", "g+h%20.png"]
    assert names(depth=5) == ["a.png", "b.JPG", "d.webp", "e.png", "f.png", "g+h%20.png"]
    assert names(depth=2, least=2) == ["e.png"] and names(suffixes="txt") == ["c.txt"]
    rows = folder_listing(spark, [root, root + "/", root + "/s"], depth=1)
    assert rows.count() == 6 and rows.where(F.col("root") == root + "/s").count() == 2
    pushed = folder_listing(spark, root, depth=2).where("depth = 1 and name like 'd%' and length in (8, 9)")
    assert [r.name for r in pushed.collect()] == ["d.webp"]
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "StartsWith" not in plan
    assert folder_listing(spark, root + "/none").count() == 0
    assert folder_listing(spark, root).where("modified_at > timestamp'2100-01-01'").count() == 0

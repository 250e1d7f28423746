"""Structured Streaming: file polling, the review fold, windows, and telemetry sinks."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import POLL_SECONDS
from tessera.operators.review import check_telemetry
from tessera.plans import bindings as b
from tessera.plans.registry import register
from tessera.store import scratch_folder, scratch_path
from tessera.streaming import folds, signatures


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; each new file is read once (offset log instead of change watermarks)."""
    schema = b.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def delivered(spark: SparkSession, sf_dir: str, first: Column, run: Callable[[DataFrame, str], None]) -> str:
    """Events as two deliveries into one folder, the rows of ``first`` and then the rest; ``run`` (stream, folder) runs after each.

    Each run starts the stream anew from its checkpoint, as after a stop. Gives the folder.
    """
    events = b.table(spark, sf_dir, "events")
    base = scratch_path(spark, "deliveries")
    middle = events.agg(F.expr("(min(unix_micros(CAST(ts AS timestamp))) + max(unix_micros(CAST(ts AS timestamp)))) div 2").alias("m")).first()["m"]
    early = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(middle), F.lit(True))
    for part in (early & first, ~(early & first)):
        events.where(part).write.mode("append").parquet(f"{base}/in")
        run(spark.readStream.schema(events.schema).parquet(f"{base}/in"), base)
    return base


def run_once(stream: DataFrame, each=None, poll: bool = False):
    """Start a stream: all that is there now, or polling. ``each`` gets (batch, epoch); without it batches go to a scratch table."""
    spark = stream.sparkSession
    base = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint")
    writer = writer.trigger(processingTime=f"{POLL_SECONDS} seconds") if poll else writer.trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{base}/rows").start()
    if not poll:
        query.awaitTermination()
    return query, f"{base}/rows"


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per type and tumbling window; rows later than ``late`` are dropped in a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def swipes(events: DataFrame) -> DataFrame:
    """Events as swipes: purchases right, clicks up, errors left, views down."""
    gesture = F.create_map(*(F.lit(x) for x in ("purchase", "right", "click", "up", "error", "left", "view", "down")))
    return events.select(F.col("user_id").alias("image_id"), gesture[F.col("event_type")].alias("gesture"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


@register("st10_streamed_scores", """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 10.0 WHEN 'click' THEN 5.0 WHEN 'error' THEN -10.0 WHEN 'view' THEN 0.0 END AS d FROM events)
SELECT user_id AS image_id, list_reduce(list_prepend(50.0::DOUBLE, list(d::DOUBLE ORDER BY ts, event_id)), lambda x, y: greatest(0, least(100, x + y))) AS score
FROM e WHERE d IS NOT NULL GROUP BY 1""")
def st10(spark, sf_dir):
    def run(stream: DataFrame, base: str) -> None:
        folds.run_available(folds.streamed_scores(swipes(stream)), f"{base}/rows", f"{base}/checkpoint", mode="update")

    base = delivered(spark, sf_dir, F.lit(True), run)
    return folds.latest(spark, f"{base}/rows", folds.SCORES, "image_id").select("image_id", "score")


#: What the second delivery may still add to: the stream's watermark stands at the newest row of the first, less ten minutes.
_DELIVERED = """cut AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS m FROM events),
d AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) < m AND event_id % 10 <> 0 AS early FROM events, cut),
w AS (SELECT (max(us) FILTER (early) // 1000 - 600000) * 1000 AS w1, (max(us) // 1000 - 600000) * 1000 AS w2 FROM d)"""


@register("st11_closed_windows", f"""WITH {_DELIVERED}, x AS (SELECT *, us // 3600000000 * 3600000000 AS start FROM d, w)
SELECT make_timestamp(start) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x WHERE (early OR start + 3600000000 > w1) AND start + 3600000000 <= w2 GROUP BY 1, 2""")
def st11_windows(spark, sf_dir):
    base = delivered(spark, sf_dir, F.col("event_id") % 10 != 0, lambda s, at: folds.run_available(folds.windowed(s), f"{at}/rows", f"{at}/checkpoint"))
    rows = spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"{base}/rows")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_GAP = 1_800_000_000
_SESSIONS = """{o} AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {gap} THEN 0 ELSE 1 END AS new FROM {i})),
{o}s AS (SELECT user_id, s, min(us) AS first, max(us) + {gap} AS past, count(*) AS n FROM {o} GROUP BY 1, 2)"""


@register("st11_sessions", f"""WITH {_DELIVERED}, i1 AS (SELECT user_id, us, event_id FROM d WHERE early), {_SESSIONS.format(o='f', i='i1', gap=_GAP)},
f_open AS (SELECT user_id, s FROM fs, w WHERE past > w1),
i2 AS (SELECT user_id, us, event_id FROM f JOIN f_open USING (user_id, s) UNION ALL SELECT user_id, us, event_id FROM d, w WHERE NOT early AND us + {_GAP} > w1), {_SESSIONS.format(o='g', i='i2', gap=_GAP)},
done AS (SELECT * FROM fs, w WHERE past <= w1 UNION ALL SELECT * FROM gs, w WHERE past <= w2)
SELECT user_id, make_timestamp(first) AS start, make_timestamp(past) AS "end", n FROM done""")
def st11_sessions(spark, sf_dir):
    base = delivered(spark, sf_dir, F.col("event_id") % 10 != 0, lambda s, at: folds.run_available(folds.sessions(s), f"{at}/rows", f"{at}/checkpoint"))
    rows = spark.read.schema("user_id bigint, start timestamp, end timestamp, n bigint").parquet(f"{base}/rows")
    return rows.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@register("st11_windowed_counts", """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def st11(spark, sf_dir):
    found = windowed_counts(b.table(spark, sf_dir, "events"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("st5_streamed_telemetry", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st5(spark, sf_dir):
    events = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("event_name"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_id"), F.lit("info").alias("severity"), F.lit("{}").alias("payload")
    )
    state = f"{scratch_folder(spark)}/telemetry-{uuid.uuid4().hex}"

    def each(batch: DataFrame, epoch: int) -> None:
        good, bad = check_telemetry(batch)
        good.write.mode("overwrite").parquet(f"{state}/good/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{state}/rejected/epoch={epoch}")

    run_once(events, each)
    return spark.read.parquet(f"{state}/good").groupBy(F.col("event_name").alias("event_type")).agg(F.count("*").alias("n"))


@register("e5_signature_job", f"""WITH {b.IMAGES_SQL}, t AS (SELECT id, list_filter(list_distinct(regexp_split_to_array(lower(prompt_pos), '[,\\s]+')), lambda x: x <> '') AS w FROM images WHERE trim(prompt_pos) <> ''),
c AS (SELECT id, list_transform(range(0, 8), lambda i: len(list_filter(w, lambda x: ('0x' || substr(md5(x), 1, 4))::INT % 8 = i))::DOUBLE) AS n FROM t)
SELECT id AS image_id, array_to_string(list_transform(n, lambda x: round(x / sqrt(list_inner_product(n, n)), 4)::DECIMAL(9, 4)), ',') AS vec FROM c WHERE list_sum(n) > 0""")
def e5(spark, sf_dir):
    """Two jobs: the first is stopped after a chunk, the second of the same name does the rest."""
    images = b.images(spark, sf_dir)
    folder = scratch_path(spark, "signatures")
    for stop in (True, False):
        job = signatures.SignatureJob(spark, folder, "text", "hashed-words", signatures.hashed_words())
        job.plan(images, chunk=math.ceil(images.count() / 4))
        query = job.start()
        if stop and query is not None:
            while query.isActive and not job.status().done:
                time.sleep(0.2)
            job.cancel()
        status = job.wait()
    assert status.finished
    four = F.transform("vec", lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string"))
    return job.rows().where("vec is not null").select("image_id", F.array_join(four, ",").alias("vec"))

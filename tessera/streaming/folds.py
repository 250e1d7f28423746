"""Stateful streams: scores kept per image, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.constants import BASE_SCORE, HIGHEST, LOWEST, SWIPE_STEPS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORES = "image_id bigint, score double, folded bigint, waiting int"


#: Groups of images that keep their state together; fixed for the life of a checkpoint.
SHARDS = 512
_DONE = np.dtype([("image", "<i8"), ("score", "<f8"), ("folded", "<i8")])
_WAITING = np.dtype([("image", "<i8"), ("at", "<i8"), ("seq", "<i8"), ("step", "<f8")])


class ScoreFold(StatefulProcessor):
    """Images' scores: folded up to the watermark, with the swipes after it waiting in order.

    State per shard of images: ``done`` (image, score, number of folded swipes) and
    ``waiting`` (image, at, seq, step), the swipes that an earlier one may still precede, as packed arrays:
    a call for each image would cost more than its fold.
    A timer at the oldest waiting swipe folds what the watermark has passed, so
    an idle image ends with one row. Swipes under the watermark are dropped by the
    stream, as its delay says.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "done binary, waiting binary")

    @staticmethod
    def _fold(score: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """``score`` after the steps of the images ``at`` in their order."""
        found = score.tolist()
        for i, step in zip(at.tolist(), steps.tolist()):
            found[i] = max(LOWEST, min(HIGHEST, found[i] + step))
        return np.array(found, np.float64)

    def _settle(self, new: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed, keep the rest, and give the scores over both of the images with news."""
        kept = self.state.get() if self.state.exists() else (b"", b"")
        done, waiting = np.frombuffer(bytes(kept[0]), _DONE), np.frombuffer(bytes(kept[1]), _WAITING)
        waiting = np.concatenate([waiting, new])
        waiting = waiting[np.lexsort((waiting["step"], waiting["seq"], waiting["at"], waiting["image"]))]
        passes = waiting["at"] <= watermark * 1000
        passed, rest = waiting[passes], waiting[~passes]
        seen = np.union1d(passed["image"], new["image"])
        if not len(seen):
            return
        now = np.zeros(len(np.union1d(done["image"], new["image"])), _DONE)
        now["image"], now["score"] = np.union1d(done["image"], new["image"]), BASE_SCORE
        now[np.searchsorted(now["image"], done["image"])] = done
        at = np.searchsorted(now["image"], passed["image"])
        now["score"] = self._fold(now["score"], at, passed["step"])
        now["folded"] += np.bincount(at, minlength=len(now))
        self.state.update((now.tobytes(), rest.tobytes()))
        if len(rest):
            self.handle.registerTimer(int(rest["at"].min()) // 1000 + 1)
        later = np.searchsorted(now["image"], rest["image"])
        score, held, shown = self._fold(now["score"], later, rest["step"]), np.bincount(later, minlength=len(now)), np.searchsorted(now["image"], seen)
        yield pd.DataFrame({"image_id": seen, "score": score[shown], "folded": now["folded"][shown], "waiting": held[shown].astype(np.int32)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [np.zeros(0, _WAITING)]
        for part in rows:
            new.append(np.zeros(len(part), _WAITING))
            new[-1]["image"], new[-1]["at"], new[-1]["seq"], new[-1]["step"] = part["image_id"], part["at_us"], part["seq"], part["gesture"].map(SWIPE_STEPS)
        yield from self._settle(np.concatenate(new), max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(np.zeros(0, _WAITING), max(0, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def streamed_scores(swipes: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (image_id, score, folded, waiting): each image's score whenever it gets swipes (image_id, gesture, at, seq)."""
    steps = swipes.where(F.col("gesture").isin(*SWIPE_STEPS) & F.col("image_id").isNotNull() & F.col("at").isNotNull())
    shard = F.pmod(F.xxhash64("image_id"), F.lit(SHARDS)).alias("shard")
    timed = steps.withWatermark("at", late).select(shard, "image_id", "at", F.unix_micros("at").alias("at_us"), F.coalesce("seq", F.lit(0)).alias("seq"), "gesture")
    return timed.groupBy("shard").transformWithStateInPandas(ScoreFold(), SCORES, "Update", "EventTime")


def run_available(stream: DataFrame, rows: str, checkpoint: str, each_file: bool = False, mode: str = "append") -> None:
    """Run a stream over all that is there, from where its checkpoint stands; batches are kept under ``rows`` by number.

    A batch that is run again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def latest(spark: SparkSession, rows: str, schema: str, key: str) -> DataFrame:
    """The newest row of each key among a stream's kept batches."""
    kept = spark.read.schema(f"{schema}, batch long").parquet(rows)
    newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc("batch")))
    return kept.withColumn("_place", newest).where("_place = 1").drop("_place", "batch")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream's counts and sums per type and tumbling window (start, event_type, n, total): once closed, each once; late rows are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream's sessions per user (user_id, start, end, n): rows less than ``gap`` apart; given once no row can join them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

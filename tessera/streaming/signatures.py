"""Signature jobs: vectors for images that lack one, in chunks that are kept as they finish; cancelled and resumed at will."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tessera.functions.text import token_set

#: The image columns a tower may read, and what a job keeps.
TODO = "image_id bigint, prompt_pos string, abs_path string"
ROWS = "image_id bigint, slot string, model_id string, dim int, vec array<double>"
Tower = Callable[[DataFrame], DataFrame]


@dataclass
class Status:
    """Images of the job, those with a vector, those that gave none, and whether it was cancelled."""

    total: int
    done: int
    failed: int
    cancelled: bool = False

    @property
    def finished(self) -> bool:
        return self.done + self.failed >= self.total


def hashed_words(dims: int = 8) -> Tower:
    """A tower of built-in functions: counts of the prompt's words by 16 bits of their MD5, as a unit vector; none without words."""
    def tower(rows: DataFrame) -> DataFrame:
        word = rows.select("image_id", F.explode(token_set(F.coalesce("prompt_pos", F.lit("")))).alias("w"))
        at = word.select("image_id", (F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("int") % dims).alias("at"))  # one MD5 a word
        found = at.groupBy("image_id").agg(F.array(*(F.count_if(F.col("at") == i).cast("double") for i in range(dims))).alias("n"))
        size = F.sqrt(F.aggregate("n", F.lit(0.0), lambda s, x: s + x * x))
        return found.withColumn("size", size).select("image_id", F.transform("n", lambda x: x / F.col("size")).alias("vec"))

    return tower


def candidates(images: DataFrame, slot: str) -> DataFrame:
    """Images a tower can see: for ``text`` those with a prompt, for ``vision`` those that are neither hidden nor missing."""
    if slot == "text":
        return images.where(F.trim(F.coalesce("prompt_pos", F.lit(""))) != "")
    seen = ~F.coalesce(F.col("hidden"), F.lit(False))
    return images.where(seen & ~F.coalesce(F.col("file_missing"), F.lit(False)) if "file_missing" in images.columns else seen)


class _Progress(StreamingQueryListener):
    """Chunks that the job's own query has committed."""

    def __init__(self, name: str) -> None:
        self.name, self.chunks = name, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.numInputRows:
            self.chunks += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class SignatureJob:
    """One tower's job under ``folder`` (shared storage).

    The plan is written once: the candidates without a signature of this slot and
    model (all with ``force``), in files of about ``chunk`` images. A stream takes
    one file at a time and keeps its vectors under the number of its batch, which
    the checkpoint commits afterwards; a chunk that was cut short is done again
    and replaces its own rows, so no image is kept twice. A job of the same name
    goes on where the last one stopped. One job a tower runs at a time.
    """

    _running: set[str] = set()
    _turn = Lock()

    def __init__(self, spark: SparkSession, folder: str, slot: str, model: str, tower: Tower) -> None:
        self.spark, self.folder, self.slot, self.model, self.tower = spark, folder.rstrip("/"), slot, model, tower
        self.name = f"signatures-{slot}-{model}"
        self.tag = f"{self.name}-{abs(hash(self.folder))}"
        self.progress, self.query, self.cancelled = _Progress(self.name), None, False

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def plan(self, images: DataFrame, computed: DataFrame | None = None, chunk: int = 64, force: bool = False) -> int:
        """Write what is to do, unless a job is there to resume; how many images."""
        there = self._read("todo", TODO).count()
        if there:
            return there
        rows = candidates(images, self.slot).select(F.col("id").alias("image_id"), "prompt_pos", "abs_path").where("image_id is not null").dropDuplicates(["image_id"])
        if computed is not None and not force:
            own = computed.where((F.col("slot") == self.slot) & (F.col("model_id") == self.model))
            rows = rows.join(own.select("image_id").distinct(), "image_id", "left_anti")
        n = rows.count()
        if n:
            rows.repartitionByRange(math.ceil(n / chunk), "image_id").write.parquet(f"{self.folder}/todo")
        return n

    def _chunk(self, batch: DataFrame, number: int) -> None:
        batch.sparkSession.addTag(self.tag)
        try:
            if self.cancelled:
                raise RuntimeError("cancelled")
            batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism, "image_id")  # a chunk is one file
            vectors = self.tower(batch)
            rows = batch.select("image_id").join(vectors, "image_id", "left").select(
                "image_id", F.lit(self.slot).alias("slot"), F.lit(self.model).alias("model_id"), F.size("vec").alias("dim"), F.col("vec").cast("array<double>").alias("vec")
            )
            rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")
        except Exception:
            if self.cancelled:  # a short word instead of the interrupted job's traces; the chunk is not committed
                raise RuntimeError(f"{self.name}: cancelled in chunk {number}") from None
            raise
        finally:
            batch.sparkSession.removeTag(self.tag)

    def start(self) -> StreamingQuery | None:
        """Begin or go on; the running query, or none if there is nothing to do."""
        if not self._read("todo", TODO).count():
            return None
        with SignatureJob._turn:
            if self.name in SignatureJob._running:
                raise RuntimeError(f"{self.name} is running")
            SignatureJob._running.add(self.name)
        self.cancelled = False
        self.spark.streams.addListener(self.progress)
        chunks = self.spark.readStream.schema(TODO).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/todo")
        writer = chunks.writeStream.queryName(self.name).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(self._chunk)
        self.query = writer.trigger(availableNow=True).start()
        return self.query

    def cancel(self) -> None:
        """Stop now: the running chunk's Spark jobs are interrupted, finished chunks stay."""
        self.cancelled = True
        self.spark.interruptTag(self.tag)
        if self.query is not None:
            self.query.stop()

    def wait(self) -> Status:
        """The status once the query has ended, by itself or cancelled; a tower's own failure is raised."""
        try:
            if self.query is not None:
                self.query.awaitTermination()
        except Exception:
            if not self.cancelled:
                raise
        finally:
            SignatureJob._running.discard(self.name)
            self.spark.streams.removeListener(self.progress)
        return self.status()

    def status(self) -> Status:
        """Counts from what is kept."""
        kept = self.rows().agg(F.count_if(F.col("vec").isNotNull()), F.count_if(F.col("vec").isNull())).first()
        return Status(self._read("todo", TODO).count(), kept[0], kept[1], self.cancelled)

    def rows(self) -> DataFrame:
        """The kept signatures; images that gave no vector have none."""
        return self._read("rows", ROWS)

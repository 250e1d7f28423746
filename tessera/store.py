"""Tables on plain Parquet in buckets of their keys: upserts, anti-join deletes, and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import CASCADE, KEYS, ddl

_OWN: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session (tests) gets a folder of its own; on a
    cluster no machine's own folder would do, so that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _OWN[0]
    return f"{base}/tessera-{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table_of(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as a scratch table and read again.

    Cuts the lineage: a lost executor costs at most a re-read of the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_column(table: str) -> str:
    """The key column whose hash is a row's bucket: the image where there is one, so that a cascade stays in the image's bucket."""
    return "image_id" if "image_id" in KEYS[table] else KEYS[table][0]


def upserted(rows: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """``rows``, with those of equal keys replaced by ``changes``."""
    return rows.join(changes.select(*by), by, "left_anti").unionByName(changes, allowMissingColumns=True)


def absent(rows: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Those of ``new`` whose keys ``rows`` lacks."""
    return new.join(rows.select(*by), by, "left_anti")


def updated(rows: DataFrame, changes: DataFrame, by: list[str], nulls: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the columns of ``changes`` at equal keys.

    A null in ``changes`` leaves the old value, but in the columns of ``nulls``
    it replaces it. The keys of ``changes`` are unique.
    """
    new = [c for c in changes.columns if c not in by]
    other = changes.select(*by, F.struct(*new).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in nulls else F.coalesce(f"_new.{c}", c)
    return rows.join(other, by, "left").select(*((value(c).alias(c) if c in new else F.col(c)) for c in rows.columns))


class Store:
    """A library of tables under one folder; one writer at a time.

    A table is Parquet partitioned by the hash of a key (``buckets`` of them, the
    same number for the life of a library). A change reads and writes only the
    buckets that hold its keys, through Spark's dynamic partition overwrite:
    tasks write beside the table and the job's commit swaps the buckets in, so a
    lost executor or a failed job leaves the table as it was. A bucket keeps one
    row without ``_row``, so that one left without rows is swapped too. Frames read before
    a change do not outlive it: read again, or keep them by ``table_of``.
    Changes but ``append`` may be applied again after a failure with the same result.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _stored(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{ddl(table)}, _row boolean, _bucket int").parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def has(self, table: str) -> bool:
        """Whether the table has ever been written."""
        return self._stored(table) is not None

    def _rows(self, table: str) -> DataFrame:
        found = self._stored(table)
        if found is None:
            found = self.spark.createDataFrame([], f"{ddl(table)}, _row boolean, _bucket int")
        return found.where("_row").drop("_row")

    def read(self, table: str) -> DataFrame:
        return self._rows(table).drop("_bucket")

    def _shaped(self, table: str, df: DataFrame, only: bool = False) -> DataFrame:
        """``df`` in the table's types; its own columns ``only``, or all with nulls for those it lacks."""
        columns = self.spark.createDataFrame([], ddl(table)).schema.fields
        value = lambda c: (F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name)
        return df.select(*(value(c) for c in columns if not only or c.name in df.columns))

    def _bucketed(self, table: str, df: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64(bucket_column(table)), F.lit(self.buckets)).cast("int")
        return df.withColumn("_bucket", hashed)

    def _touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of some keys, at most ``buckets`` numbers; all where the keys do not tell."""
        if bucket_column(table) not in keys.columns:
            return list(range(self.buckets))
        return [r[0] for r in self._bucketed(table, keys).select("_bucket").distinct().collect()]

    def _write(self, table: str, df: DataFrame, touched: list[int], mode: str = "overwrite") -> None:
        """Swap in the ``touched`` buckets, which hold all rows of ``df``; ``append`` adds files to them."""
        rows = self._bucketed(table, self._shaped(table, df)).withColumn("_row", F.lit(True))
        if mode == "overwrite":
            marks = self.spark.createDataFrame([(k, False) for k in touched], "_bucket int, _row boolean")
            rows = rows.unionByName(marks, allowMissingColumns=True)
        writer = rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").mode(mode)
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{table}")

    def _part(self, table: str, touched: list[int]) -> DataFrame:
        return self._rows(table).where(F.col("_bucket").isin(touched)).drop("_bucket")

    def overwrite(self, table: str, df: DataFrame) -> None:
        """Replace the whole table."""
        self._write(table, df, list(range(self.buckets)))

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows, whose keys the caller knows to be new; no bucket is read."""
        self._write(table, df, [], "append")

    def upsert(self, table: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """Rows of ``df`` replace those with their keys."""
        by = keys or KEYS[table]
        new = table_of(self._shaped(table, df))
        if touched := self._touched(table, new):  # new rows may fall in any bucket, also where other keys find the old ones
            whole = touched if bucket_column(table) in by else list(range(self.buckets))
            self._write(table, upserted(self._part(table, whole), new, by), whole)

    def insert_absent(self, table: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """Rows of ``df`` whose keys the table lacks; it is read, and files are added to it."""
        by = keys or KEYS[table]
        new = table_of(self._shaped(table, df))
        whole = self._touched(table, new) if bucket_column(table) in by else list(range(self.buckets))
        if whole:
            self.append(table, table_of(absent(self._part(table, whole), new, by)))

    def update(self, table: str, changes: DataFrame, keys: list[str] | None = None, nulls: tuple[str, ...] = ()) -> None:
        """Columns of ``changes`` replace those of rows with equal keys; a null only in the columns of ``nulls``."""
        by = keys or KEYS[table]
        new = table_of(self._shaped(table, changes, only=True))
        if touched := self._touched(table, new.select(*by)):
            self._write(table, updated(self._part(table, touched), new, by, nulls), touched)

    def delete(self, table: str, hit: Column | str) -> int:
        """Delete the rows for which ``hit`` is true; how many. Only buckets with such rows are written."""
        hit = F.coalesce(F.expr(hit) if isinstance(hit, str) else hit, F.lit(False))
        counts = self._rows(table).where(hit).groupBy("_bucket").count().collect()
        if touched := [r["_bucket"] for r in counts]:
            self._write(table, self._part(table, touched).where(~hit), touched)
        return sum(r["count"] for r in counts)

    def delete_images(self, ids: DataFrame) -> None:
        """Delete images (id) and what hangs on them.

        The images go last: where a driver ends in between, they still stand, and
        the next pass deletes them and the rest.
        """
        gone = table_of(ids.select(F.col("id").cast("bigint")).distinct())
        for table, column in [*CASCADE.items(), ("images", "id")]:
            key = gone.withColumnRenamed("id", column)
            if self.has(table) and (touched := self._touched(table, key)):
                self._write(table, self._part(table, touched).join(key, column, "left_anti"), touched)

    def delete_missing(self, source_id: int, listing: DataFrame) -> DataFrame:
        """Delete a source's images that the listing (norm_path) lacks; (id, group_key_l1) of those."""
        own = self.read("images").where(F.col("source_id") == source_id)
        gone = table_of(own.join(listing.select(F.col("norm_path").alias("abs_path")), "abs_path", "left_anti").select("id", "group_key_l1"))
        self.delete_images(gone)
        return gone

    def hide(self, level_column: str, key: str, source_id: int | None = None) -> int:
        """Hide a group's images; how many changed."""
        hit = (F.col(level_column) == key) & ~F.coalesce("hidden", F.lit(False))
        if source_id is not None:
            hit = hit & (F.col("source_id") == source_id)
        counts = self._rows("images").where(hit).groupBy("_bucket").count().collect()
        if touched := [r["_bucket"] for r in counts]:
            self._write("images", self._part("images", touched).withColumn("hidden", F.coalesce(F.when(hit, True), F.col("hidden"))), touched)
        return sum(r["count"] for r in counts)

    def prune_templates(self, keep: DataFrame) -> None:
        """Delete the templates whose path ``keep`` lacks."""
        gone = table_of(self.read("workflow_templates").join(keep.select("path"), "path", "left_anti").select("path"))
        if touched := self._touched("workflow_templates", gone):
            self._write("workflow_templates", self._part("workflow_templates", touched).join(gone, "path", "left_anti"), touched)

    def delete_label(self, label_id: int) -> None:
        """Delete a label and its marks on images; the label goes last."""
        self.delete("image_labels", F.col("label_id") == label_id)
        self.delete("labels", F.col("id") == label_id)

"""Export rows, the archive plan and its copies."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import sanitize_name
from tessera.operators.groups import label_lists

#: Columns of an export, in order (fixed values).
COLUMNS = (
    "filename", "abs_path", "source", "prompt_positive", "prompt_negative", "model", "loras", "vae", "sampler", "seed", "steps", "cfg",
    "group_key", "labels", "score", "notes", "scanned_at",
)


def export_rows(images: DataFrame, sources: DataFrame, scores: DataFrame, image_labels: DataFrame, labels: DataFrame, source_id: int | None = None) -> DataFrame:
    """(id and ``COLUMNS``) of the images of known sources (id, path): one row each, score null where there is none.

    LoRAs are JSON text, the sampler is that of the first pass, labels are
    joined by semicolons, notes are empty. Columns that ``images`` lacks are empty.
    """
    rows = images if source_id is None else images.where(F.col("source_id") == source_id)
    paths = sources.select(F.col("id").alias("_src"), F.col("path").alias("source"))
    s = scores.select(F.col("image_id").alias("_s"), F.col("internal_score").alias("score"))
    names = label_lists(image_labels, labels).select(F.col("image_id").alias("_l"), F.concat_ws(";", "labels").alias("_names"))
    joined = rows.join(paths, F.col("source_id") == F.col("_src")).join(s, F.col("id") == F.col("_s"), "left").join(names, F.col("id") == F.col("_l"), "left")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in images.columns else F.lit("")

    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)) if name in images.columns else F.lit(0).cast(kind)

    loras = F.coalesce(F.to_json("loras"), F.lit("")) if "loras" in images.columns else F.lit("")
    sampler = F.coalesce(F.get("samplers", F.lit(0))["sampler"], F.lit("")) if "samplers" in images.columns else F.lit("")
    return joined.select(
        "id", text("filename").alias("filename"), text("abs_path").alias("abs_path"), "source", text("prompt_pos").alias("prompt_positive"),
        text("prompt_neg").alias("prompt_negative"), text("checkpoint").alias("model"), loras.alias("loras"), text("vae").alias("vae"), sampler.alias("sampler"),
        number("seed", "bigint").alias("seed"), number("steps", "bigint").alias("steps"), number("cfg", "double").alias("cfg"),
        text("group_key_l3").alias("group_key"), F.coalesce("_names", F.lit("")).alias("labels"), "score", F.lit("").alias("notes"), text("scanned_at").alias("scanned_at"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """``COLUMNS`` with a header in every part file, scores with two places, empty fields bare."""
    score = F.when(F.col("score").isNull(), "").otherwise(F.format_string("%.2f", "score"))
    out = rows.withColumn("score", score).select(*COLUMNS)
    out.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """``COLUMNS`` as JSON lines, scores in full or null."""
    rows.select(*COLUMNS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def archive_folder(rule: str) -> Column:
    """Folder of an image under a rule: flat, by checkpoint, or by labels."""
    if rule == "checkpoint":
        return F.coalesce(F.nullif(sanitize_name(F.col("checkpoint")), F.lit("")), F.lit("unknown"))
    if rule == "labels":
        joined = F.concat_ws("_", F.transform("labels", sanitize_name))
        return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unlabeled"))
    return F.lit("")


def archive_plan(images: DataFrame, rule: str = "flat", taken: DataFrame | None = None) -> DataFrame:
    """(id, abs_path, folder, name): where each file goes, no two to one name, none to one ``taken`` (folder, filename).

    The first file (by id) of a name keeps it unless it is taken. The others
    get stem_1, stem_2 ..., over names that are taken or some file's own.
    """
    stem, suffix = F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1)
    rows = images.select("id", "abs_path", archive_folder(rule).alias("folder"), "filename", stem.alias("stem"), suffix.alias("suffix"))
    there = rows.select("folder", "filename").limit(0) if taken is None else taken.select("folder", "filename")
    mark = there.distinct().withColumn("gone", F.lit(True))
    order = W.partitionBy("folder", "filename").orderBy("id")
    placed = rows.join(mark, ["folder", "filename"], "left").withColumn("rank", F.row_number().over(order) - F.when(F.col("gone"), 0).otherwise(1))
    numbered = r"^(.+)_([1-9]\d{0,8})((?:\.[^.]*)?)$"
    part = lambda k: F.regexp_extract("filename", numbered, k)
    used = rows.select("folder", "filename").union(there).distinct().where(F.col("filename").rlike(numbered)).select(
        "folder", part(1).alias("stem"), part(3).alias("suffix"), part(2).cast("bigint").alias("k")
    )
    # the j-th used number is passed by every file whose rank is at least that number less those used before it
    group = ["folder", "stem", "suffix"]
    passed = used.withColumn("v", F.col("k") - F.row_number().over(W.partitionBy(*group).orderBy("k")) + 1)
    late = placed.where("rank > 0").select(*group, "id", F.col("rank").cast("bigint").alias("v"))
    both = late.withColumn("step", F.lit(0)).unionByName(passed.select(*group, F.lit(None).cast("bigint").alias("id"), "v").withColumn("step", F.lit(1)))
    over = F.sum("step").over(W.partitionBy(*group).orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow))
    moved = both.withColumn("number", F.col("v") + over).where("step = 0").select(F.col("id").alias("_i"), "number")
    name = F.when(F.col("number").isNull(), F.col("filename")).otherwise(F.concat("stem", F.lit("_"), F.col("number").cast("string"), "suffix"))
    return placed.join(moved, F.col("id") == F.col("_i"), "left").select("id", "abs_path", "folder", name.alias("name"))


def _copied(batches: Iterator[pa.RecordBatch], dest: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def at(path: str) -> tuple:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    for batch in batches:
        done = []
        for image, source, folder, name in zip(*(batch.column(c).to_pylist() for c in ("id", "abs_path", "folder", "name"))):
            (system, there), target = at(source), "/".join(x for x in (dest, folder, name) if x)
            if system.get_file_info(there).type != fs.FileType.File:
                continue
            end, path = at(target)
            end.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_input_stream(there) as source_file, end.open_output_stream(path) as copy:
                while piece := source_file.read(1 << 20):
                    copy.write(piece)
            done.append((image, target, int(time.time())))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["image_id", "dest_path", "at"])


def copy_files(plan: DataFrame, dest: str) -> DataFrame:
    """Copies the files of a plan under ``dest`` and gives the log of those copied (image_id, dest_path, archived_at).

    Files that are missing are skipped. A target is fixed by the plan, so a task
    that runs again writes the same copy; write the result down once, each use copies again.
    """
    found = plan.select(F.col("id").cast("bigint").alias("id"), "abs_path", "folder", "name").mapInArrow(partial(_copied, dest=dest.rstrip("/")), "image_id bigint, dest_path string, at bigint")
    return found.select("image_id", "dest_path", F.timestamp_seconds("at").alias("archived_at"))


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """The archive log with new rows in the place of older ones of their image."""
    return log.join(new.select("image_id"), "image_id", "left_anti").select(*new.columns).unionByName(new)

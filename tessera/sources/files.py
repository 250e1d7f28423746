"""Image listings, template scans and companions, read by Spark's own file sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import IMAGE_SUFFIXES, STABILITY_SECONDS, TEMPLATE_DEPTH
from tessera.functions.parameters import prompts
from tessera.functions.text import normalize_path
from tessera.sources.folder_source import folder_listing
from tessera.sources.metadata import parse_image

_GLOB = "*.{" + ",".join(f"[{s[0]}{s[0].upper()}]" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s[1:]) for s in IMAGE_SUFFIXES) + "}"


def binary_files(spark: SparkSession, root: str, with_content: bool = False, only: Column | None = None) -> DataFrame:
    """Images of a folder and its subfolders (one level): path, modificationTime, length and, where asked for, content.

    ``only`` is a filter of modificationTime and length: the source opens no file outside it.
    """
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("pathGlobFilter", _GLOB)
    df = read.load([base, f"{base}/*/"]) if with_subfolders(spark, base) else read.load(base)
    df = df if only is None else df.where(only)
    columns = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    return df.select(*columns).distinct() if not with_content else df.select(*columns).dropDuplicates(["path"])


def with_subfolders(spark: SparkSession, base: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(base)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in fs.listStatus(at))


def listing_stats(files: DataFrame) -> DataFrame:
    """File count and newest change of a listing."""
    return files.agg(F.count("*").alias("file_count"), F.max("modificationTime").alias("newest"))


def stable(files: DataFrame, now: Column | None = None, seconds: float = STABILITY_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(ready, pending): files unchanged for the stability window, and the younger ones."""
    age = F.unix_seconds(now if now is not None else F.current_timestamp()) - F.unix_seconds("modificationTime")
    return files.where(age >= seconds), files.where(age < seconds)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def companions(spark: SparkSession, root: str) -> DataFrame:
    """(stem, text) of the text files beside images."""
    texts = spark.read.text(root, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return texts.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))


def with_companion(parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """Parsed images whose prompts are both empty take them from the companion text."""
    split = F.split(F.col("_text"), r"(?m)Negative prompt:|Negative:", 2)
    rows = parsed.withColumn("_stem", stem(F.col("path"))).join(texts.select(F.col("stem").alias("_stem"), F.col("text").alias("_text")), "_stem", "left")
    bare = (F.col("meta.prompt_pos") == "") & (F.col("meta.prompt_neg") == "") & F.col("_text").isNotNull()
    rows = rows.withColumn("_full", F.when(bare & F.contains(F.col("_text"), F.lit("Steps:")), prompts(F.col("_text"))))
    positive = F.when(bare, F.coalesce("_full.positive", F.trim(F.get(split, 0)))).otherwise(F.col("meta.prompt_pos"))
    negative = F.when(bare, F.coalesce("_full.negative", F.trim(F.coalesce(F.get(split, 1), F.lit(""))))).otherwise(F.col("meta.prompt_neg"))
    meta = F.col("meta").withField("prompt_pos", positive).withField("prompt_neg", negative)
    return rows.withColumn("meta", meta).drop("_stem", "_text", "_full")


def parsed_images(spark: SparkSession, root: str) -> DataFrame:
    """Images of a folder with their metadata (struct ``meta``); a file that cannot be read keeps a default row."""
    files = binary_files(spark, root, with_content=True)
    return files.select("path", "modificationTime", "length", parse_image("path", "content").alias("meta"))


_TEMPLATE = (
    "path string, name string, workflow_id string, t array<string>, e array<string>, node_count bigint, diffusion_models array<string>, model_chain array<string>"
)
_UI = "nodes array<struct<id: bigint, type: string, widgets_values: array<string>>>, links array<array<string>>, id string"


def same_path(path: Column) -> Column:
    """One spelling of a path, whichever reader it comes from; local files have no scheme."""
    return normalize_path(F.regexp_replace(path, "^file:/+", "/"))


def templates(spark: SparkSession, roots: str | list[str], depth: int = TEMPLATE_DEPTH) -> DataFrame:
    """Workflow templates under one or more roots, up to ``depth`` levels down (1: files of the root itself), once each; by lower-case name."""
    return templates_of(spark, folder_listing(spark, roots, depth=depth - 1, suffixes="json"))


def templates_of(spark: SparkSession, listing: DataFrame, glob: str = "*.[jJ][sS][oO][nN]") -> DataFrame:
    """Templates among listed files (folder, path): UI graphs as JSON with name, id, canonical types and edges, node count, models and chain.

    The listed files are opened by the tasks that have their paths, by the file systems that listed them; one that is gone is left out.
    """
    paths = listing.select("path").distinct().repartition(4 * spark.sparkContext.defaultParallelism, "path")
    opened = paths.mapInArrow(partial(_contents, glob=glob), "path string, content binary")
    return parsed_templates(opened.select(same_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("value")))


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_texts(rows: DataFrame) -> None:
    """Write each ``value`` as the file ``path``, with its folders, by the task that has it; a task that runs again writes the same."""
    rows.select("path", "value").mapInArrow(_written, "path string").write.format("noop").mode("overwrite").save()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, value in zip(*(batch.column(c).to_pylist() for c in ("path", "value"))):
            folder, name = path.rsplit("/", 1)
            system, at = _system(folder)
            system.create_dir(at, recursive=True)
            draft = f"{at}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft, compression=None) as file:
                file.write(value.encode())
            system.move(draft, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"path": batch.column("path")})


def _contents(batches: Iterator[pa.RecordBatch], glob: str) -> Iterator[pa.RecordBatch]:
    """(path, content) of the files whose names match, one at a time."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            folder, name = path.rsplit("/", 1)
            if not fnmatchcase(name, glob):
                continue
            try:
                system, at = _system(folder)
                with system.open_input_stream(f"{at}/{name}", compression=None) as file:
                    content = file.read()
            except OSError:
                continue
            yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([content], pa.binary())})


def parsed_templates(raw: DataFrame) -> DataFrame:
    """Templates of JSON texts (path, value); what is no UI graph is left out."""
    g = raw.select("path", F.from_json("value", _UI).alias("g")).where(F.col("g.nodes").isNotNull())
    nodes = F.filter("g.nodes", lambda n: F.coalesce(n["type"], F.lit("")) != "")
    kind = F.map_from_entries(F.transform(nodes, lambda n: F.struct(n["id"], n["type"])))
    link = F.filter(F.coalesce("g.links", F.array().cast("array<array<string>>")), lambda x: F.size(x) >= 6)
    edge = F.transform(link, lambda x: F.concat_ws("->", F.try_element_at(F.col("kind"), x[1].try_cast("bigint")), F.try_element_at(F.col("kind"), x[3].try_cast("bigint"))))
    loader = F.filter(nodes, lambda n: n["type"].rlike("(?i)checkpoint|unet|diffusion|lora|vae|clip"))
    chain = F.filter(F.transform(loader, lambda n: F.concat_ws(":", n["type"], F.get(n["widgets_values"], F.lit(0)))), lambda s: F.contains(s, F.lit(":")))
    diffusion = F.transform(F.filter(loader, lambda n: n["type"].rlike("(?i)checkpoint|unet|diffusion")), lambda n: F.get(n["widgets_values"], F.lit(0)))
    shaped = g.withColumn("kind", kind).select(
        "path", F.regexp_extract("path", r"(?i)([^/]*)\.json$", 1).alias("name"), F.col("g.id").alias("workflow_id"),
        F.array_sort(F.transform(nodes, lambda n: n["type"])).alias("t"), F.array_sort(F.filter(edge, lambda e: F.contains(e, F.lit("->")))).alias("e"),
        F.size(nodes).cast("bigint").alias("node_count"), F.array_sort(F.array_distinct(F.filter(diffusion, lambda m: m.isNotNull()))).alias("diffusion_models"),
        chain.alias("model_chain"),
    )
    return shaped.dropDuplicates(["path"]).orderBy(F.lower("name"), "path")


def foreign_library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an older SQLite library, read-only; missing columns take their defaults.

    The standard library reads the one file on the driver, as it must; at
    cluster scale libraries are Parquet tables and read as such.
    """
    import sqlite3

    import pandas as pd

    from tessera.schemas import select_with_defaults, tables

    found = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        for name in ("images", "labels", "image_labels", "scores", "manual_group_bindings"):
            if name in there and name in tables():
                rows = pd.read_sql_query(f"SELECT * FROM {name}", db)
                keep = rows[[c for c in rows.columns if rows[c].notna().any()]]
                found[name] = select_with_defaults(spark.createDataFrame(keep) if len(keep) else spark.createDataFrame([], "id bigint"), name)
    return found

"""Folder trees as a Spark data source: ``spark.read.format("media_folders")``, and as a stream of changed listings.

Options: ``paths`` (a JSON list of roots, or one path), ``depth`` (folder levels
under a root; 0 is the root alone), ``least`` (the least level), ``suffixes``
(comma-separated, any case; ``*`` for all), ``settle`` (seconds a file must be unchanged to be
listed; in a stream, to count: there the default is the stability window). Roots are URIs or paths that every
machine sees (local mounts, hdfs, s3).

The driver goes down until it has found ``SPREAD`` folders on a level; tasks walk on below
those, several to a partition. Filters on the columns
(but modified_at) run inside the listing, and folders that a filter on ``root``, ``folder`` or
``depth`` rules out are never opened but to go below them. Folders that cannot be read, or vanish, are empty.

The stream's offset is what the settled listing looked like: number of files,
newest change, and a sum of path digests. A change of any of them (new, changed,
renamed or deleted files) makes a micro-batch with the whole listing, younger
files included, so that none seems to be gone while it is written; a restart from
the checkpoint without a change makes none.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from tessera.constants import IMAGE_SUFFIXES, STABILITY_SECONDS

SCHEMA = "root string, folder string, depth int, path string, name string, modified_at timestamp, length bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_OPERATORS: dict[type, Callable] = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda x, values: x in values, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains,
}


#: Folders of a level that tasks walk down from, and the most partitions of a listing.
SPREAD, PARTITIONS = 16, 256


@dataclass
class Folder:
    """One folder to list."""

    root: str
    folder: str
    depth: int


@dataclass
class Folders(InputPartition):
    """Folders to list, and those to walk down from."""

    lone: list[Folder]
    tops: list[Folder]


class _Tree:
    def __init__(self, options: dict) -> None:
        paths = options.get("paths") or options.get("path") or "[]"
        self.roots = sorted({str(p).rstrip("/") or "/" for p in (json.loads(paths) if paths.lstrip().startswith("[") else [paths])})
        self.depth, self.least = int(options.get("depth", 1)), int(options.get("least", 0))
        self.suffixes = tuple("." + s.strip().lower() if s.strip() != "*" else "" for s in options.get("suffixes", ",".join(IMAGE_SUFFIXES)).split(","))
        self.settle = float(options.get("settle", 0))

    @staticmethod
    def _listed(folder: str) -> list:
        from pyarrow import fs

        try:
            system, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            own = system.get_file_info(at)
            return [own] if own.type == fs.FileType.File else sorted(system.get_file_info(fs.FileSelector(at, recursive=False)), key=lambda i: i.path)
        except OSError:
            return []

    def below(self, at: Folder) -> list[Folder]:
        """The folders in a folder, if they are not too deep."""
        from pyarrow import fs

        if at.depth >= self.depth:
            return []
        return [Folder(at.root, f"{at.folder.rstrip('/')}/{i.base_name}", at.depth + 1) for i in self._listed(at.folder) if i.type == fs.FileType.Directory]

    def walk(self, level: list[Folder], wanted: Callable[[dict], bool] = lambda row: True) -> Iterator[Folder]:
        """Wanted folders of a level and below it, in any order; ``level`` is used up."""
        while level:
            at = level.pop()
            if at.depth >= self.least and wanted({"root": at.root, "folder": at.folder, "depth": at.depth}):
                yield at
            level += self.below(at)

    def folders(self) -> Iterator[Folder]:
        return self.walk([Folder(r, r, 0) for r in self.roots])

    def partitions(self, wanted: Callable[[dict], bool] = lambda row: True) -> list[Folders]:
        """All folders, dealt into partitions."""
        level, lone = [Folder(r, r, 0) for r in self.roots], []
        while level and len(level) < SPREAD and level[0].depth < self.depth:
            lone += [f for f in level if f.depth >= self.least and wanted({"root": f.root, "folder": f.folder, "depth": f.depth})]
            level = [b for f in level for b in self.below(f)]
        parts = max(1, min(PARTITIONS, len(lone) + len(level)))
        return [Folders(lone[k::parts], level[parts - 1 - k :: parts]) for k in range(parts)]

    def of(self, part: Folders, wanted: Callable[[dict], bool] = lambda row: True) -> Iterator[Folder]:
        """The wanted folders of a partition."""
        yield from part.lone
        yield from self.walk(list(part.tops), wanted)

    def files(self, part: Folder, settle: float) -> Iterator[tuple]:
        """Rows of a folder's files that have been unchanged for ``settle`` seconds."""
        from pyarrow import fs

        now = time.time()
        for info in self._listed(part.folder):
            if info.type != fs.FileType.File or not info.base_name.lower().endswith(self.suffixes):
                continue
            changed = (info.mtime_ns or 0) // 1000
            if settle and now - changed / 1e6 < settle:
                continue
            at = dt.datetime.fromtimestamp(changed / 1e6, dt.timezone.utc)
            lone = part.depth == 0 and part.folder.endswith(info.path)  # a root that is a file
            path = part.folder if lone else f"{part.folder.rstrip('/')}/{info.base_name}"
            yield (part.root, part.folder, part.depth, path, info.base_name, at, info.size)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tree, self.tests = _Tree(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the comparisons of its columns; gives back what Spark must still do."""
        for f in filters:
            if isinstance(f, IsNotNull):  # no column is ever null
                continue
            if type(f) in _OPERATORS and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS and f.attribute[0] != "modified_at":
                value = tuple(f.value) if isinstance(f, In) else f.value
                self.tests.append((f.attribute[0], type(f), value))
            else:
                yield f

    def _passes(self, row: dict) -> bool:
        return all(c not in row or _OPERATORS[kind](row[c], value) for c, kind, value in self.tests)

    def partitions(self) -> list[Folders]:
        return self.tree.partitions(self._passes)

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in self.tree.of(partition, self._passes):
            for row in self.tree.files(folder, self.tree.settle):
                if self._passes(dict(zip(_COLUMNS, row))):
                    yield row


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.tree = _Tree({"settle": STABILITY_SECONDS} | dict(options))

    def initialOffset(self) -> dict:
        return {"files": 0, "newest": 0, "digest": 0}

    def latestOffset(self) -> dict:
        import xxhash

        files, newest, digest = 0, 0, 0
        for folder in self.tree.folders():
            for _, _, _, path, _, at, length in self.tree.files(folder, self.tree.settle):
                changed = round(at.timestamp() * 1e6)
                files, newest = files + 1, max(newest, changed)
                digest = (digest + xxhash.xxh3_64_intdigest(f"{path}|{changed}|{length}".encode())) % 2**63
        return {"files": files, "newest": newest, "digest": digest}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.tree.partitions()

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in self.tree.of(partition):
            yield from self.tree.files(folder, 0)

    def commit(self, end: dict) -> None:
        pass


class MediaFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.options)


def _options(paths: str | list[str], options: dict) -> dict[str, str]:
    return {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths))} | {k: str(v) for k, v in options.items()}


def folder_listing(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Files under the roots, once each; ``options`` as above."""
    spark.dataSource.register(MediaFolders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("media_folders").options(**_options(paths, options)).load()


def folder_changes(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """A stream with the whole listing whenever what has settled has changed."""
    spark.dataSource.register(MediaFolders)
    return spark.readStream.format("media_folders").options(**_options(paths, options)).load()

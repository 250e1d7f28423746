"""WARC archives: written by Spark's text sink, read in splits by boundary-chain verification (operator 13).

The bytes "WARC/1." can stand inside a payload, so a task that starts in the
middle of a file cannot know where a record starts. Tasks read their splits cut
at these bytes (the text source does that across split borders) and take every
occurrence as a candidate: one whose header can be read says where its
successor starts. Within its split a task follows the chains at once, so each
candidate gets its way out of the split. Pointer jumping over these ways, from
the start of each file, finds where the true chain enters each split, in rounds
that grow with the logarithm of the number of splits; a last pass within the
splits keeps the records on the chain. Candidates inside payloads are never
reached. A broken record ends its file's chain.

Payloads are hashed where they are read; only contents that hold the magic
bytes themselves are put together from their pieces afterwards. Splits are
pinned by settings of a session of their own, so that both scans cut alike.

Nulls and edges: a null html is an empty payload; a null url leaves its header
line out, line breaks in one are percent-encoded. Payloads under
``least`` bytes are always responses. Rows with a null page_id are responses,
and so are rows that repeat the page_id of their payload's response. Extra
columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.store import scratch_path

MAGIC = b"WARC/1."
_END = b"\r\n\r\n"
_ID = "urn:x-tessera-page:"
_LINE = re.compile(rb"[!-9;-~]+:|[ \t]")
#: Revisits up to this many are broadcast to the writing tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_SCAN = (
    "file string, block long, at long, next long, exit long, pending boolean, complete boolean, body long, length long, header binary, "
    "payload_bytes long, payload_digest string, total long, lead binary, lead_done boolean"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


# ------------------------------------------------------------------ writing


def decided(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is the response's page_id of a revisit, else null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    slim = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisits = cut(slim.join(first, "payload_digest").where("page_id <> refers_to").distinct(), "revisits")
    small = revisits.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(revisits) if small else revisits, ["page_id", "payload_digest"], "left")


def record(date: str) -> Column:
    """A page's WARC record, but for the empty lines after it."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    again = F.col("refers_to").isNotNull()
    content = F.when(again, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\n"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), "payload_digest", F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers_to"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content,
    )


def write_pages(pages: DataFrame, path: str, least: int = 100, date: str = "2000-01-01T00:00:00Z") -> None:
    """One record per page into archives under ``path``; equal payloads of at least ``least`` bytes are written once."""
    decided(pages, least).select(record(date).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


# ------------------------------------------------------------------ candidates


def header_end(data: bytes) -> int | None:
    """Where the header's empty line is: an index, -1 if it is not there yet, None if this is no header."""
    end = data.find(_END)
    lines = data[3 : end if end >= 0 else len(data)].split(b"\r\n")
    whole = lines if end >= 0 else lines[:-1]
    return end if all(_LINE.match(x) for x in whole if x) else None


def fields(header: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines are joined."""
    found, name = {}, ""
    for line in header.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def content_length(header: bytes) -> int | None:
    named = fields(header)
    size = named.get("content-length", "")
    return int(size) if size.isascii() and size.isdigit() and len(size) < 19 and "warc-type" in named and "warc-record-id" in named else None


def payload_of(header: bytes, content: bytes) -> tuple[int | None, str | None, bytes | None]:
    """(bytes, SHA-256, payload) of a record: a revisit's are those of what it stands for, and it has no payload."""
    named = fields(header)
    http = named.get("content-type", "").lower().startswith("application/http")
    at = content.find(_END) if http else -1
    body = content[at + 4 :] if at >= 0 else content
    if named.get("warc-type", "").lower() != "revisit":
        return len(body), hashlib.sha256(body).hexdigest(), body
    size = fields(content[:at]).get("content-length", "") if at >= 0 else ""
    digest = named.get("warc-payload-digest", "")
    return int(size) if size.isdigit() else None, digest.split(":", 1)[1].lower() if digest.lower().startswith("sha256:") else None, None


class _Block:
    """The pieces of one split. Offsets count from its first piece, which starts behind a magic unless the file starts there."""

    def __init__(self, file: str, start: int) -> None:
        self.file, self.start, self.total = file, start, 0
        self.rows: list[dict] = []
        self.open: list[tuple[dict, bytes]] = []  # candidates whose header goes on in the next piece
        self.lead, self.lead_done = b"", False

    def add(self, piece: bytes) -> None:
        first, at = not self.rows, self.total - len(MAGIC)
        self.total += len(piece) + len(MAGIC)
        row = {"at": at}
        self.rows.append(row)
        waiting, self.open = self.open, []
        for earlier, begun in waiting:
            self._head(earlier, begun + MAGIC + piece)
        if not self.lead_done and self.lead is not None:
            self._lead(piece, first)
        if not (first and self.start == 0) and piece[:3] in (b"0\r\n", b"1\r\n"):
            self._head(row, piece)

    def _lead(self, piece: bytes, first: bool) -> None:
        """The split's bytes up to the end of a header that may have begun before it."""
        self.lead = piece if first else self.lead + MAGIC + piece
        end = self.lead.find(_END)
        lines = self.lead[: end if end >= 0 else len(self.lead)].split(b"\r\n")[1:]
        if not all(_LINE.match(x) for x in (lines if end >= 0 else lines[:-1])):
            self.lead = None
        elif end >= 0:
            self.lead, self.lead_done = self.lead[: end + 4], True

    def _head(self, row: dict, data: bytes) -> None:
        """Read a candidate's header from ``data``, which starts at its version."""
        end = header_end(data)
        if end is None:
            return
        if end < 0:
            self.open.append((row, data))
            return
        header = data[3:end]
        length = content_length(header)
        if length is None:
            return
        body, have = len(MAGIC) + end + 4, len(data) - end - 4
        tail = data[end + 4 + length : end + 8 + length]
        if tail != _END[: len(tail)]:
            return
        row |= {"header": header, "body": body, "length": length, "next": row["at"] + body + length + 4, "complete": have >= length}
        if row["complete"]:
            row["payload_bytes"], row["payload_digest"], _ = payload_of(header, data[end + 4 : end + 4 + length])

    def done(self) -> Iterator[dict]:
        for row, begun in self.open:
            row |= {"header": begun, "pending": True}
        place = {r["at"]: r for r in self.rows}
        for row in reversed(self.rows):
            to = row.get("next")
            if to is None:
                continue
            then = place.get(to)
            row["exit"] = to if to >= self.total - len(MAGIC) else None if then is None else to if then.get("pending") else then.get("exit")
        for row in self.rows:
            yield row | {"file": self.file, "block": self.start}
        yield {"file": self.file, "block": self.start, "total": self.total, "lead": self.lead, "lead_done": self.lead_done}


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in named], names=[n for n, _ in named])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = None
    for batch in batches:
        out: list[dict] = []
        for file, start, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece"))):
            if block is None or (block.file, block.start) != (file, start):
                out += block.done() if block else []
                block = _Block(file, start)
            block.add(piece)
        yield _rows(out, _SCAN)
    if block:
        yield _rows(list(block.done()), _SCAN)


# ------------------------------------------------------------------ chains


def pieces(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, block, piece): the archives cut at the magic bytes, in splits that depend on nothing but the files."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes) if split_bytes else spark.conf.get("spark.sql.files.maxPartitionBytes"))
    lines = own.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df``, of the scanning session, as a scratch table of ``spark``."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stitched(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, at, ...) of headers that go on in later splits, put together with the starts of those."""
    waiting = rows.where("pending").select("file", "at", F.col("header").alias("begun"), F.col("number").alias("upto"))
    done = []
    while not waiting.isEmpty():
        following = blocks.select("file", (F.col("number") - 1).alias("upto"), "lead", "lead_done")
        grown = cut(
            waiting.join(following, ["file", "upto"]).where("lead is not null").select(
                "file", "at", F.concat("begun", F.lit(MAGIC), "lead").alias("begun"), (F.col("upto") + 1).alias("upto"), "lead_done"
            ), "headers",
        )
        done.append(grown.where("lead_done"))
        waiting = grown.where("not lead_done").drop("lead_done")
    found = done[0] if done else rows.where("false").select("file", "at", F.col("header").alias("begun"))
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select("file", "at", "begun").mapInArrow(_headers, "file string, at long, next long, body long, length long, header binary")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            end = header_end(row["begun"])
            length = content_length(row["begun"][3:end]) if end is not None and end >= 0 else None
            if length is not None:
                body = len(MAGIC) + end + 4
                out.append({"file": row["file"], "at": row["at"], "next": row["at"] + body + length + 4, "body": body, "length": length, "header": row["begun"][3:end]})
        yield _rows(out, "file string, at long, next long, body long, length long, header binary")


def entries(candidates: DataFrame) -> DataFrame:
    """(file, at): where the true chain enters each split, by pointer jumping from the start of each file."""
    ways = candidates.where("exit is not null")
    targets = ways.select("file", F.col("exit").alias("at")).distinct()
    jump = cut(
        ways.select("file", "at", F.col("exit").alias("to")).join(targets.union(ways.where("at = 0").select("file", "at")).distinct(), ["file", "at"], "left_semi"), "jumps"
    )
    reach = jump.where("at = 0").select("file", "at")
    while True:
        reach = cut(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reach")
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(onward, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")
        if jump.isEmpty():
            return reach


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, expected, owner = None, None, None
    for batch in batches:
        owners, kept = [], []
        for file, block, at, to, entry in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "at", "next", "entry"))):
            if (file, block) != where:
                where, expected, owner = (file, block), None, None
            hit = to is not None and (entry or at == expected)
            if hit:
                expected, owner = to, at
            owners.append(owner)
            kept.append(hit)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owners, pa.int64()), pa.array(kept, pa.bool_())], names=[*batch.schema.names, "owner", "on_chain"])


def chained(cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All candidates with absolute offsets, whether they are on their file's chain, and the record that holds them; and the splits."""
    spark = cuts.sparkSession
    file = W.partitionBy("file").orderBy("block")
    blocks = cuts.where("total is not null").select(
        "file", "block", "lead", "lead_done", F.row_number().over(file).alias("number"),
        (F.coalesce(F.sum("total").over(file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"),
    )
    blocks = cut(blocks, "blocks")
    shift = lambda c: (F.col(c) + F.col("base")).alias(c)
    rows = cuts.where("total is null").join(blocks.select("file", "block", "base", "number"), ["file", "block"]).select(
        "file", "block", "number", F.col("at").alias("piece_at"), *(shift(c) for c in ("at", "next", "exit")), F.coalesce("pending", F.lit(False)).alias("pending"),
        F.coalesce("complete", F.lit(False)).alias("complete"), "body", "length", "header", "payload_bytes", "payload_digest",
    )
    if not cuts.where("pending").isEmpty():
        rows = cut(rows, "candidates")
        late = _stitched(rows, blocks)
        new = late.select("file", "at", *(F.col(c).alias(f"late_{c}") for c in ("next", "body", "length", "header")))
        pick = lambda c: F.when(F.col("pending"), F.col(f"late_{'next' if c == 'exit' else c}")).otherwise(F.col(c)).alias(c)
        swapped = {"next", "exit", "body", "length", "header"}
        rows = rows.join(new, ["file", "at"], "left").select(*(pick(c) if c in swapped else F.col(c) for c in rows.columns))
    rows = cut(rows, "candidates")
    entry = entries(rows).withColumn("entry", F.lit(True))
    dealt = rows.join(entry, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False))).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    schema = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes) + ", owner long, on_chain boolean"
    return cut(dealt.mapInArrow(_marked, schema), "chained"), blocks.select("file", "block", "number")


def _scan_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, at = None, 0
    for batch in batches:
        places = []
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece"))):
            if (file, block) != where:
                where, at = (file, block), 0
            places.append(at - len(MAGIC))
            at += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "piece_at"])


def contents(scan: DataFrame, marked: DataFrame, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, at, header, content) of the wanted records (file, at), put together from their pieces by a second scan."""
    heads = marked.where("on_chain").groupBy("file", "block").agg(F.max("at").alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("number").rowsBetween(W.unboundedPreceding, -1))
    carried = blocks.join(heads, ["file", "block"], "left").withColumn("carried", before).select("file", "block", "carried")
    owned = marked.join(carried, ["file", "block"]).select("file", "block", "piece_at", F.col("at").alias("place"), F.coalesce("owner", "carried").alias("at"))
    about = marked.where("on_chain").select("file", "at", "body", "length", "header").join(wanted, ["file", "at"], "left_semi")
    owned = cut(owned.join(about.select("file", "at"), ["file", "at"], "left_semi"), "owned")
    small = owned.count() <= BROADCAST_ROWS // 10
    spark = marked.sparkSession
    placed = scan.mapInArrow(_scan_positions, "file string, block long, piece binary, piece_at long")
    found = placed.join(F.broadcast(owned) if small else owned, ["file", "block", "piece_at"]).select("file", "at", "place", "piece")
    parts = _kept(spark, found, "pieces").groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    return about.join(parts, ["file", "at"]).mapInArrow(_contents, "file string, at long, header binary, content binary")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            data = MAGIC + MAGIC.join(p["piece"] for p in r["parts"])
            out.append({"file": r["file"], "at": r["at"], "header": r["header"], "content": data[r["body"] : r["body"] + r["length"]]})
        yield _rows(out, "file string, at long, header binary, content binary")


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            size, digest, payload = payload_of(r["header"], r["content"])
            out.append({"file": r["file"], "at": r["at"], "late_bytes": size, "late_digest": digest, "payload": payload})
        yield _rows(out, "file string, at long, late_bytes long, late_digest string, payload binary")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = {"record_type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date", "refers": "warc-refers-to"}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            named = fields(r["header"])
            out.append(r | {k: named.get(v) for k, v in keys.items()})
        yield _rows(out, _RECORD)


_RECORD = (
    "file string, at long, length long, record_type string, record_id string, uri string, date string, refers string, payload_bytes long, payload_digest string"
)


def read(spark: SparkSession, path: str, split_bytes: int | None = None, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``: file, at (offset), length, record_type, record_id, uri, date, refers, payload_bytes, payload_digest.

    With ``payloads`` also payload (null for revisits), which costs a second scan.
    """
    scan = pieces(spark, path, split_bytes)
    marked, blocks = chained(_kept(spark, scan.mapInArrow(_candidates, _SCAN), "cuts"))
    records = marked.where("on_chain")
    found = records.select("file", "at", "length", "header", "payload_bytes", "payload_digest").mapInArrow(_named, _RECORD)
    wanted = records.select("file", "at") if payloads else records.where("not complete").select("file", "at")
    if not payloads and wanted.isEmpty():
        return found
    late = contents(scan, marked, blocks, wanted).mapInArrow(_payloads, "file string, at long, late_bytes long, late_digest string, payload binary")
    full = found.join(late, ["file", "at"], "left")
    chosen = [F.coalesce("late_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("late_digest", "payload_digest").alias("payload_digest")]
    return full.select(*(c for c in found.columns if not c.startswith("payload_")), *chosen, *(["payload"] if payloads else []))


def page_of(record_id: Column) -> Column:
    """The page_id in a record's id."""
    return F.regexp_extract(record_id, rf"^<{_ID}(-?\d+)>$", 1).try_cast("long")


def archived(pages: DataFrame) -> DataFrame:
    """Pages through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_pages(pages, path)
    return read(spark, path).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers")).alias("refers_to")
    )


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND payload_bytes >= 100"""

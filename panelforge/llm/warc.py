"""Operator 3: WARC archives as a PySpark data source, ``format("warc")``.

Writing: each task writes archives of gzip members, a record each, to temporary
names, a new one after ``PART_BYTES``; the driver's commit renames the files of the attempts that succeeded, so lost
executors leave nothing half-written behind. Each member's gzip header holds the
sizes of the member (the ``sl`` extra field of the WARC annex on compression), so that a reader can
go to the next record without inflating this one. (A member of 4 GiB or more has no such field, and is inflated.)

Reading: a partition is a run of files of up to ``PART_BYTES`` together. Predicates on
record type and headers are pushed to the reader: it inflates a record's headers
first, tests them, and goes past a record that fails (or whose payload is not
asked for: option ``payload`` = ``false``) without inflating its payload.

Paths go through pyarrow's file systems (local, HDFS, S3, GCS by URI).

A payload is the body of the HTTP response that a ``response`` record holds; a ``revisit``
holds the HTTP headers alone and names the record that has the payload.

Edge cases: a null payload is an empty one; a payload may hold any bytes and is held whole, however long; header values
lose line breaks; archives of other writers without ``sl`` are read by inflating,
with or without a ``warcinfo`` record (it has a type, and headers as it gives them); an archive, of whatever size, is one task's; a
truncated record raises an error; an empty table makes no archive, and an empty folder reads as an empty table.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from panelforge.llm.common import shared_dir

MIN_REVISIT = 100
PART_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Column, header, kind. Headers are strings but for the sizes.
COLUMNS = (
    ("warc_type", "WARC-Type", "string"),
    ("record_id", "WARC-Record-ID", "string"),
    ("target_uri", "WARC-Target-URI", "string"),
    ("warc_date", "WARC-Date", "string"),
    ("payload_digest", "WARC-Payload-Digest", "string"),
    ("payload_bytes", "X-Payload-Length", "long"),
    ("refers_to", "WARC-Refers-To", "string"),
    ("content_length", "Content-Length", "long"),
)
SCHEMA = ", ".join(f"{c} {k}" for c, _, k in COLUMNS) + ", payload binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _text(value: str) -> bytes:
    return " ".join(str(value).split()).encode()


def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, size: int, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record's bytes, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    block = http + payload if kind == "response" else http
    heads = [(b"WARC-Type", kind.encode()), (b"WARC-Record-ID", _text(record_id)), (b"WARC-Date", _text(date)), (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha256:" + digest.encode()), (b"X-Payload-Length", str(size).encode())]
    if uri is not None:
        heads.append((b"WARC-Target-URI", _text(uri)))
    if refers_to is not None:
        heads += [(b"WARC-Refers-To", _text(refers_to)), (b"WARC-Profile", PROFILE.encode())]
    heads.append((b"Content-Length", str(len(block)).encode()))
    return b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in heads) + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL, most: int = 0xFFFFFFFF) -> bytes:
    """A gzip member with its sizes in the header, where they fit."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    if max(whole, len(data)) > most:  # the field has 32 bits a size: a reader inflates such a member
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + (8).to_bytes(2, "little") + whole.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int):
        self.path, self.level = path.rstrip("/"), level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        files, out = [], None
        for b in iterator:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in cols.items()}
                if out is not None and out.tell() >= PART_BYTES:  # an archive is read by one task
                    out.close()
                    out = None
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    files.append((f"{root}/_temporary-{name}", f"{root}/{name}"))
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(files[-1][0], compression=None)
                out.write(member(record(row["warc_type"], row["record_id"], row["target_uri"], row["payload_digest"], row["payload"] or b"", row["payload_bytes"], row["refers_to"]), self.level))
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        for temporary, final in (f for m in messages if m for f in m.files):
            fs.move(temporary, final)

    def abort(self, messages: list[Written]) -> None:
        fs, _ = _open(self.path)
        for temporary, _ in (f for m in messages if m for f in m.files):
            if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
                fs.delete_file(temporary)


class Member:
    """One gzip member, inflated no further than asked."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.end = f, start, end
        f.seek(start)
        head = f.read(24)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        self.size = int.from_bytes(head[16:20], "little") if head[3] == 4 and head[12:14] == b"sl" else None
        self.z = zlib.decompressobj(31)
        self.fed = head
        self.out = bytearray()

    def more(self, least: int) -> None:
        """Inflate until ``least`` bytes are there or the member ends."""
        while len(self.out) < least and not self.z.eof:
            data = self.z.unconsumed_tail or self.fed or self.f.read(1 << 16)
            if not data:
                raise EOFError(f"the record at byte {self.start} is truncated")
            if not self.z.unconsumed_tail:
                self.fed = b""
            self.out += self.z.decompress(data, max(1, least - len(self.out)))

    def headers(self) -> tuple[dict[str, str], int]:
        """Names in lower case; where the block starts."""
        at = -1
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            if self.z.eof:
                raise EOFError(f"the record at byte {self.start} has no headers")
            self.more(len(self.out) + 1024)
        lines = self.out[:at].decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, at + 4

    def next(self) -> int:
        """Where the next member starts."""
        if self.size:
            return self.start + self.size
        while not self.z.eof:
            self.more(len(self.out) + (1 << 16))
            del self.out[:-4]
        return self.f.tell() - len(self.z.unused_data)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(None)
        self.paths = tuple(paths)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path.rstrip("/"), payload, []

    def pushFilters(self, filters):
        known = {c for c, _, _ in COLUMNS}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in known and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(".warc.gz") and not x.base_name.startswith("_"))
        parts, run, size = [], [], 0
        for p, n in files:
            if run and size + n > PART_BYTES:
                parts.append(Files(run))
                run, size = [], 0
            run.append(p)
            size += n
        return [*parts, *([Files(run)] if run else [])] or [Files([])]

    def _wanted(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None:
                return False
            if isinstance(f, EqualTo) and v != f.value or isinstance(f, In) and v not in f.value or isinstance(f, StringStartsWith) and not v.startswith(f.value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                end, at = raw.size(), 0
                f = io.BufferedReader(raw, 1 << 18) if hasattr(raw, "readinto") else raw
                while at < end:
                    m = Member(f, at, end)
                    heads, block = m.headers()
                    row = {c: (heads.get(h.lower()) if k == "string" else int(heads.get(h.lower(), "0"))) for c, h, k in COLUMNS}
                    if self._wanted(row):
                        row["payload"] = self._payload(m, block, row["content_length"]) if self.payload and row["warc_type"] == "response" else None
                        held += len(row["payload"] or b"") + 400
                        rows.append(row)
                        if held >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, held = [], 0
                    at = m.next()
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _payload(m: Member, block: int, length: int) -> bytes:
        m.more(block + length)
        body = bytes(m.out[block : block + length])
        if len(body) < length:
            raise EOFError(f"the record at byte {m.start} is truncated")
        return body[body.index(b"\r\n\r\n") + 4 :]

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64()}
        cols = [pa.array([r[c] for r in rows], kinds[k]) for c, _, k in COLUMNS]
        return pa.record_batch([*cols, pa.array([r["payload"] for r in rows], pa.binary())], [*(c for c, _, _ in COLUMNS), "payload"])


class WarcSource(DataSource):
    """Options: path; payload (``true``); level (of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", LEVEL)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, page_id: str = "page_id", uri: str = "url", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """The records of pages: of equal payloads of ``least`` bytes or more the smallest page_id's is response, others revisit it.

    Rows equal in page_id and payload are alike (all response, or all revisit). A null page_id ranks after others: such
    rows revisit a page with an id, and are all response where none has one.
    The group that shares a payload meets in one partial aggregation; the join back is on the digest, whose hot keys Spark splits.
    """
    raw = F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(uri).cast("string").alias("target_uri"), raw.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    low = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.count("page_id").alias("_n"), F.count("*").alias("_all"))
    low = low.where("lo <> hi OR _n <> _all").select(F.col("payload_digest").alias("_d"), "lo")
    both = rows.join(low, (F.col("payload_digest") == F.col("_d")), "left")
    again = F.col("lo").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lo"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return both.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        name("page_id").alias("record_id"),
        "target_uri",
        "payload_digest",
        "payload_bytes",
        F.when(again, name("lo")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, level: int = LEVEL) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").mode("append").option("path", path).option("level", level).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of pages to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest come from the payload read; a revisit's from its headers, its payload being elsewhere.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    full = read(spark, path).where("warc_type = 'response'")
    full = full.select("record_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "warc_type", "refers_to")
    light = read(spark, path, payload=False).where("warc_type = 'revisit'")
    light = light.select("record_id", "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "warc_type", "refers_to")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")
    return full.unionByName(light).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lo FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> lo THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> lo THEN lo END AS refers_to
FROM m
"""

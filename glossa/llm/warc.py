"""WARC archives as a PySpark Python data source, and pages written to and read from them.

Reading plans file partitions (byte ranges between record boundaries that the writer noted, or whole files), pushes down
predicates on the record type and other headers, parses a record's headers first, and decodes a payload only if the
schema asks for it and the headers passed: a gzip member written here carries its length, so an unwanted one is
skipped without inflating it; in foreign files it is inflated but not kept. Decoded payloads are checked against their digest.

Writing gives each task a file of its own (rolled by size) under a fresh name, one gzip member a record; only the commit's
manifest makes files visible, so attempts of lost executors leave nothing that is read. Files are reached through
``pyarrow.fs``, so any store that it knows will do.

Pages with equal payloads: the smallest ``page_id`` is the response, others revisit it. Copies are found on digests, with
partial minima, so a payload that a third of all pages share moves as small rows.

Defined results: a null html is an empty payload; a null url is left out of the record; a null ``page_id`` is never the
smallest (such pages are responses where no equal page has an id); rows that repeat both ``page_id`` and payload are all
of the type of that id; no rows make an archive without records; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, WriterCommitMessage)
from pyspark.sql.types import StructType

from glossa.llm.common import prepare, store

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
          "refers_to string, content_length long, payload binary")
#: What the writer takes; payload is null for a revisit.
RECORDS = ("record_id string, record_type string, target_uri string, refers_to string, payload_sha1 binary, "
           "payload_bytes long, payload binary")
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES = 256 << 20, 16 << 20, 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = struct.Struct("<4sIBBH2sHII")  # a gzip header whose extra field "sl" holds the member's and the record's length


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# ---- records ------------------------------------------------------------------------------------

def _header_line(name: str, value: str) -> bytes:
    clean = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)
    return f"{name}: {clean}\r\n".encode()


def record_bytes(row: dict, date: str) -> bytes:
    """A WARC/1.1 record, before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    head = [b"WARC/1.1\r\n", _header_line("WARC-Type", row["record_type"]), _header_line("WARC-Record-ID", f"<{row['record_id']}>"),
            _header_line("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append(_header_line("WARC-Target-URI", row["target_uri"]))
    head.append(_header_line("WARC-Payload-Digest", "sha1:" + digest(row["payload_sha1"])))
    if row["record_type"] == "revisit":
        head += [_header_line("WARC-Refers-To", f"<{row['refers_to']}>"), _header_line("WARC-Profile", REVISIT)]
    head += [b"Content-Type: application/http; msgtype=response\r\n", _header_line("Content-Length", str(len(block))), b"\r\n"]
    return b"".join([*head, block, b"\r\n\r\n"])


def member(record: bytes) -> bytes:
    """``record`` as one gzip member that tells its length."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = _MEMBER.size + len(body) + 8
    head = _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(raw: bytes) -> dict[str, str]:
    """Lower-case name -> value; continued lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out[name := name.strip().lower()] = value.strip()
    return out


def _described(head: dict[str, str]) -> dict:
    """The columns that headers give."""
    bare = lambda v: v.strip("<>") if v else None
    return {"record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
            "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "refers_to": bare(head.get("warc-refers-to")), "content_length": int(head.get("content-length", 0))}


def _finish(row: dict, block: bytes, need_payload: bool) -> dict:
    """Columns that need the block: its HTTP head gives the full payload's length, its rest is the payload."""
    http, sep, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    length = parse_headers(http).get("content-length") if sep else None
    row["payload_bytes"] = int(length) if length else row["content_length"] - len(http) - len(sep)
    row["payload"] = None
    if need_payload and row["record_type"] == "response":
        row["payload"], row["payload_bytes"] = body, len(body)
        if row["payload_digest"] and digest(hashlib.sha1(body).digest()) != row["payload_digest"]:
            raise ValueError(f"payload of {row['record_id']} doesn't match its digest")
    return row


def _sized_members(f, start: int, end: int, wanted, need_payload: bool) -> Iterator[dict]:
    """Records of a range of members that tell their length."""
    at = start
    while at < end:
        f.seek(at)
        size = _MEMBER.unpack(f.read(_MEMBER.size))[7]
        inflate = zlib.decompressobj(-15)
        text = inflate.decompress(f.read(min(4096, size - _MEMBER.size)))
        while b"\r\n\r\n" not in text and not inflate.eof:
            text += inflate.decompress(f.read(4096))
        head, _, block = text.partition(b"\r\n\r\n")
        row = _described(parse_headers(head))
        if wanted(row):
            whole = need_payload and row["record_type"] == "response"
            while not inflate.eof and (whole or b"\r\n\r\n" not in block):
                block += inflate.decompress(f.read(1 << 20 if whole else 4096))
            yield _finish(row, block[:row["content_length"]], need_payload)
        at += size


def _streamed(f, wanted, need_payload: bool) -> Iterator[dict]:
    """Records of a foreign file, read front to back."""
    while line := f.readline():
        if not line.strip():
            continue
        raw = []
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line.rstrip(b"\r\n"))
        row = _described(parse_headers(b"\r\n".join(raw)))
        left = row["content_length"]
        keep = wanted(row)
        block = b""
        if keep:
            block = f.read(left if need_payload else min(left, 4096))
            left -= len(block)
            yield _finish(row, block, need_payload)
        while left > 0 and (part := f.read(min(left, 1 << 20))):
            left -= len(part)


def read_records(path: str, start: int = 0, end: int | None = None, wanted=lambda row: True, need_payload: bool = True) -> Iterator[dict]:
    """Records of a file, or of a range of one written here; ``wanted`` sees the columns that headers give."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        first = f.read(_MEMBER.size)
        f.seek(0)
        if first[:4] == b"\x1f\x8b\x08\x04" and first[12:14] == b"sl":
            yield from _sized_members(f, start, size if end is None else end, wanted, need_payload)
        elif first[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=f) as g:
                yield from _streamed(g, wanted, need_payload)
        elif size:
            with io.BufferedReader(f) as g:
                yield from _streamed(g, wanted, need_payload)


# ---- the data source ----------------------------------------------------------------------------

@dataclass
class Range(InputPartition):
    path: str
    start: int = 0
    end: int | None = None


@dataclass
class Written(WriterCommitMessage):
    files: list  # (name, its split points)


#: Columns that a record's WARC headers give, on which predicates are pushed down.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()
        self.types = schema
        self.tests: list[tuple[str, list | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if column in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((column, [f.value]))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((column, list(f.value)))
            elif column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        manifests = [i.path for i in infos if i.base_name.startswith("_manifest-")]
        if not manifests:
            return [Range(f"{self.path.rstrip('/')}/{i.path[len(root.rstrip('/')) + 1:]}" if i.path != root else self.path) for i in infos
                    if i.type == pafs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
        out: list[InputPartition] = []
        for m in sorted(manifests):
            with fs.open_input_stream(m) as f:
                for name, points in json.loads(f.read()):
                    out += [Range(f"{self.path.rstrip('/')}/{name}", a, b) for a, b in zip(points, points[1:])]
        return out

    def _wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (values is None or row[c] in values) for c, values in self.tests)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        kind = to_arrow_schema(self.types)
        rows, held = [], 0
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        for row in read_records(partition.path, partition.start, partition.end, self._wanted, "payload" in self.names):
            rows.append({n: row.get(n) for n in self.names})
            held += 200 + len(row["payload"] or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name, points = [], None, "", []
        at = 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, points, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                at += out.write(member(record_bytes(row, self.date)))
                if at - points[-1] >= SPLIT_BYTES:
                    points.append(at)
                if at >= FILE_BYTES:
                    out.close()
                    done.append((name, points if points[-1] == at else [*points, at]))
                    out = None
        if out is not None:
            out.close()
            done.append((name, points if points[-1] == at else [*points, at]))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if i.base_name.startswith("_manifest-"):
                    fs.delete_file(i.path)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; a schema without ``payload`` skips decoding payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- pages --------------------------------------------------------------------------------------

def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` as WARC records; equal payloads of at least ``min_bytes`` bytes become one response and revisits to it."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = page.select("page_id", F.sha2("html", 256).alias("k"), F.octet_length("html").alias("n"))
    first = store(keyed.filter(F.col("n") >= min_bytes).groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("same"))
                  .filter((F.col("same") > 1) & F.col("first").isNotNull()).select("k", "first"))
    refs = (keyed.join(first, "k").filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
            .select(F.col("page_id").alias("ref_page"), F.col("k").alias("ref_k"), "first").distinct())
    met = page.withColumn("k", F.sha2("html", 256)).join(
        refs, F.col("page_id").eqNullSafe(F.col("ref_page")) & (F.col("k") == F.col("ref_k")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    again = F.col("first").isNotNull()
    return met.select(urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.col("url").alias("target_uri"), F.when(again, urn("first")).alias("refers_to"),
                      F.unhex(F.sha1("html")).alias("payload_sha1"), F.octet_length("html").cast("long").alias("payload_bytes"),
                      F.when(~again, F.col("html").cast("binary")).alias("payload"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").option("date", date).mode("append").save(path)


def page_of(record: str):
    """The page_id in a record's name, null for pages without one."""
    return F.expr(f"try_cast(substring({record}, {len('urn:page:') + 1}) AS bigint)")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record. Responses are
    read with their payloads, which checks them; revisits by their headers alone."""
    register(spark)
    slim = ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("payload binary"))
    full = spark.read.format("warc").schema(SCHEMA).load(path).filter("record_type = 'response'")
    again = spark.read.format("warc").schema(slim).load(path).filter("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    return full.unionByName(again).select(page_of("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload",
                                          "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))

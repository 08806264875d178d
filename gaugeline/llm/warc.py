"""WARC archives as a Spark data source (`warc`), for reading and writing.

Writing: every task writes archives of its own, one gzip member per record; the commit writes a manifest of the files of
the tasks that counted, so files of lost or repeated attempts are never read. Each member carries its own length in the
gzip header's extra field (`sl`, from the format's annex on skip lengths).

Reading: a partition is a file. Headers are parsed first; conditions on record type, target address, id and refers-to
are pushed down and decided on headers alone. A record that is not wanted is stepped over without being unpacked (by its
skip length, or by Content-Length in a plain archive; a member without skip length is inflated and dropped). With option
`payload=none` no body is ever unpacked beyond its HTTP head.

A null address has no target header; control characters in an address are percent-encoded, as header lines cannot hold
them. A null payload is written as empty. An empty table gives a manifest without files, which reads as no rows."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from gaugeline.llm.common import packed, unpacked

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, ROLL_BYTES, READ_BYTES = "_manifest.json", 1 << 30, 1 << 14
ON_HEADERS = ("record_id", "record_type", "target_uri", "refers_to")


def open_fs(path: str):
    """(file system, path) of a local, file:, hdfs: or object-store address."""
    return pafs.FileSystem.from_uri(path)


def _line(name: str, value: str | None) -> str:
    return "" if value is None else f"{name}: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', value)}\r\n"


def pack(record_id: str, kind: str, uri: str | None, date: str | None, digest: str | None, refers_to: str | None, size: int, payload: bytes) -> bytes:
    """One record as a gzip member with its skip length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ("WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<{record_id}>") + _line("WARC-Date", date or DATE) + _line("WARC-Target-URI", uri)
            + _line("WARC-Payload-Digest", digest and f"sha1:{digest}") + (_line("WARC-Refers-To", f"<{refers_to}>") + _line("WARC-Profile", PROFILE) if kind == "revisit" else "")
            + f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode()
    whole = head + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(whole) + z.flush()
    total = 24 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(whole) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for b in iterator:
            for r in b.select([n for n in NAMES]).to_pylist():
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                payload = r["payload"] or b""
                member = pack(r["record_id"], r["record_type"], r["target_uri"], r["date"], r["payload_digest"], r["refers_to"],
                              len(payload) if r["payload_bytes"] is None else r["payload_bytes"], payload)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        old = f"{root}/{MANIFEST}"
        if not self.overwrite and fs.get_file_info(old).type != pafs.FileType.NotFound:
            with fs.open_input_stream(old) as f:
                files = json.loads(f.read()) + files
        with fs.open_output_stream(old) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = open_fs(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{root}/{f}")


@dataclass
class Archive(InputPartition):
    file: str


class Bytes:
    """Sequential and skipping reads of one archive."""

    def __init__(self, f):
        self.f, self.size = f, f.size()

    def at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(min(n, max(self.size - pos, 0)))


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _fields(h: dict[str, str]) -> dict:
    bare = lambda x: x.strip("<>") if x else None
    digest = h.get("warc-payload-digest")
    return {"record_id": bare(h.get("warc-record-id")), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "payload_digest": digest.partition(":")[2] if digest else None, "refers_to": bare(h.get("warc-refers-to")), "payload_bytes": None, "payload": None}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in ON_HEADERS:
                self.tests.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        fs, root = open_fs(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Archive(root)]
        manifest = f"{root}/{MANIFEST}"
        if fs.get_file_info(manifest).type != pafs.FileType.NotFound:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())
            return [Archive(f"{root}/{n}") for n in names]
        return [Archive(x.path) for x in fs.get_file_info(pafs.FileSelector(root)) if re.search(r"\.warc(\.gz)?$", x.path)]

    def wanted(self, r: dict) -> bool:
        for kind, name, value in self.tests:
            v = r[name]
            if v is None or (kind == "EqualTo" and v != value) or (kind == "In" and v not in value) or (kind == "StringStartsWith" and not v.startswith(value)):
                return False
        return True

    def read(self, partition):
        if partition is None:
            return
        fs, _ = open_fs(self.path)
        held, size = [], 0
        with fs.open_input_file(partition.file) as f:
            for r in self.records(Bytes(f)):
                held.append(r)
                size += len(r["payload"] or b"")
                if len(held) >= 512 or size > 4 << 20:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    def records(self, data: Bytes):
        pos = 0
        while pos < data.size:
            first = data.at(pos, READ_BYTES)
            if first[:2] == b"\x1f\x8b":
                r, pos = self.member(data, pos, first)
            else:
                r, pos = self.plain(data, pos, first)
            if r is not None:
                yield r

    def plain(self, data: Bytes, pos: int, buf: bytes):
        skip = len(buf) - len(buf.lstrip(b"\r\n"))
        if skip:
            return None, pos + skip
        while b"\r\n\r\n" not in buf:
            more = data.at(pos + len(buf), READ_BYTES)
            if not more:
                return None, data.size
            buf += more
        head, _, _ = buf.partition(b"\r\n\r\n")
        h = _headers(head)
        start, length = pos + len(head) + 4, int(h.get("content-length", 0))
        r = _fields(h)
        if not self.wanted(r):
            return None, start + length
        return self.block(r, data.at(start, length if self.payload and r["record_type"] == "response" else min(length, READ_BYTES))), start + length

    def member(self, data: Bytes, pos: int, buf: bytes):
        end = None
        if buf[3] & 4 and len(buf) >= 24 and buf[12:14] == b"sl":
            end = pos + struct.unpack_from("<I", buf, 16)[0]
        z, out, at = zlib.decompressobj(31), b"", pos + len(buf)
        out = z.decompress(buf, READ_BYTES)

        def more(n: int) -> bool:
            nonlocal out, at
            if z.eof:
                return False
            src = z.unconsumed_tail
            if not src:
                src = data.at(at, READ_BYTES * 16)
                at += len(src)
                if not src:
                    return False
            out += z.decompress(src, n)
            return True

        while b"\r\n\r\n" not in out and more(READ_BYTES):
            pass
        head, _, rest = out.partition(b"\r\n\r\n")
        h = _headers(head)
        r, length = _fields(h), int(h.get("content-length", 0))
        good = self.wanted(r)
        if good:
            need = length if self.payload and r["record_type"] == "response" else min(length, 4096)
            parts, got = [rest], len(rest)
            while got < need:
                out = b""
                if not more(1 << 20):
                    break
                parts.append(out)
                got += len(out)
            r = self.block(r, b"".join(parts)[:length])
        if end is None:                        # no skip length: inflate to the end of the member
            while True:
                out = b""
                if not more(1 << 20):
                    break
            end = at - len(z.unused_data)
        return (r if good else None), end

    def block(self, r: dict, block: bytes) -> dict:
        if not block.startswith(b"HTTP/"):
            r["payload"], r["payload_bytes"] = (block if self.payload else None), len(block)
            return r
        head, _, body = block.partition(b"\r\n\r\n")
        size = _headers(head).get("content-length")
        r["payload_bytes"] = int(size) if size and size.isdigit() else len(body)
        if self.payload and r["record_type"] == "response":
            r["payload"] = body
        return r


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in NAMES]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(NAMES, kinds)], names=NAMES)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "all") != "none")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def mark_revisits(df: DataFrame, id: str, payload: str, least_bytes: int = 1000) -> DataFrame:
    """Append payload_bytes, payload_digest, record_type and refers_to: of rows with equal payloads of `least_bytes` or
    more the one with the largest id is a response and the others revisit it. A null id counts as smallest; rows that
    share the largest id (repeated rows) are all responses. A null payload is empty. Groups are reduced to one row before
    the join, and a payload that many rows share is split by Spark like any skewed join side."""
    new = ["payload_bytes", "payload_digest", "record_type", "refers_to"]
    kept = [c for c in df.columns if c not in new]
    df = df.withColumn(payload, F.coalesce(F.col(f"`{payload}`"), F.lit(b"")))
    df = packed(df, kept, _id=F.col(f"`{id}`"), _p=F.col(f"`{payload}`"))
    df, id = df.select("_row", "_id", F.length("_p").cast("long").alias("payload_bytes"), F.sha1("_p").alias("payload_digest"), F.xxhash64("_p").alias("_h")), "_id"
    keys = ["payload_digest", "_h", "payload_bytes"]
    groups = df.where(F.col("payload_bytes") >= least_bytes).groupBy(*keys).agg(F.max(id).alias("_main"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    joined = df.join(groups, keys, "left")
    other = F.col("_main").isNotNull() & ~F.col(id).eqNullSafe(F.col("_main"))
    return unpacked(joined, kept, payload_bytes=F.col("payload_bytes"), payload_digest=F.col("payload_digest"),
                    record_type=F.when(other, "revisit").otherwise("response"), refers_to=F.when(other, F.col("_main")))


def write(df: DataFrame, path: str) -> None:
    """`df` has the columns of SCHEMA. A revisit's payload is not sent to the writer."""
    register(df.sparkSession)
    df.select(*NAMES[:-1], F.when(F.col("record_type") == "response", F.col("payload")).alias("payload")).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", "all" if payload else "none").load(path)

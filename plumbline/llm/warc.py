"""WARC records in ZIP packages: written as stored members with an index, read back by ranges without extraction.

A package holds `archive/data.warc.gz` (gzip members, one per record, stored without another compression) and
`indexes/index.cdxj` (one JSON line per record). The reader parses the end-of-directory records, the ZIP64 ones
included, and the central directory, and then reads only the byte ranges it needs.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, records long, bytes long"
#: Bytes that one range read takes at most, unless a single record is longer.
RANGE = 4 << 20


def open_at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# ---- ZIP ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # place of the local header


class Package:
    """Random access to the stored members of a ZIP file, given size and a function that reads a byte range."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        raw, at = self.read(start, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # only the fields that overflow are there, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                k += 4 + n
            yield Member(name, method, size, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Place of a stored member's first byte."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def member(self, name: str) -> bytes:
        return self.read(self.start(name), self.members[name].size)


# ---- WARC -----------------------------------------------------------------------------------------------------


def record(kind: str, record_id: str, uri: str, payload: bytes, headers: dict[str, str]) -> bytes:
    """One gzip member."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": uri, "WARC-Date": "1970-01-01T00:00:00Z", **headers, "Content-Type": "text/html", "Content-Length": str(len(payload))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + payload + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " " and c != "\x7f") or "urn:none"


class _Placed:
    """File object for zipfile that goes forwards only and counts."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, b) -> int:
        self.out.write(b)
        self.at += len(b)
        return len(b)

    def flush(self) -> None:
        pass


def resolved(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, revisits): for pages whose payload of at least `least` bytes is also a smaller page_id's.

    Payloads are counted by digest with partial sums; only payloads that repeat are joined back.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= least)
    first = rows.groupBy("digest").agg(F.min("page_id").alias("revisits"), F.max("page_id").alias("last")).where(F.col("last") > F.col("revisits")).drop("last")
    return rows.join(first, "digest").where(F.col("page_id") > F.col("revisits")).select("page_id", "digest", "revisits").distinct()


def write(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes one package per task under `folder` and returns the manifest (path, records, bytes), already stored.

    A retried task writes under another name; only packages of tasks that succeeded are in the manifest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, z, out, n = TaskContext.get(), None, None, 0
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.wacz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if z is None:
                fs, local = open_at(path)
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                out = _Placed(fs.open_output_stream(local))
                z, index, offset = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), [], 0
                data = z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
            for page, url, html, revisits in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisits")), strict=True):
                payload = html or b""
                digest = hashlib.sha256(payload).hexdigest()
                more = {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)), "X-Page-ID": str(page)}
                if revisits is None:
                    kind, body = "response", payload
                else:
                    kind, body = "revisit", b""
                    more |= {"WARC-Refers-To": f"<urn:page:{revisits}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                made = record(kind, f"<urn:page:{page}>", _clean(url), body, more)
                data.write(made)
                index.append(json.dumps({"page": page, "offset": offset, "length": len(made), "type": kind, "digest": digest}))
                offset += len(made)
                n += 1
        if z is not None:
            data.close()
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            z.close()
            out.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([out.at], pa.int64())], ["path", "records", "bytes"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    marked = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit(b"")), 256)).join(resolved(pages, least), ["page_id", "digest"], "left")
    spark, at = pages.sparkSession, f"{folder}/manifest"
    marked.mapInArrow(run, MANIFEST).write.parquet(at)
    return spark.read.schema(MANIFEST).parquet(at)


def ranges(entries: list[dict], most: int = RANGE) -> Iterator[list[dict]]:
    """Neighbouring records that one read takes in."""
    group: list[dict] = []
    for e in entries:
        if group and (e["offset"] != group[-1]["offset"] + group[-1]["length"] or e["offset"] + e["length"] - group[0]["offset"] > most):
            yield group
            group = []
        group.append(e)
    if group:
        yield group


def records(path: str, wanted=None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of a package's records; `wanted` picks index entries, and only these are read."""
    fs, local = open_at(path)
    with fs.open_input_file(local) as f:
        zip_ = Package(lambda at, n: f.read_at(n, at), f.size())
        start = zip_.start(DATA)
        entries = [json.loads(x) for x in zip_.member(INDEX).decode().split("\n") if x]
        for group in ranges([e for e in entries if wanted is None or wanted(e)]):
            first = group[0]["offset"]
            raw = f.read_at(group[-1]["offset"] + group[-1]["length"] - first, start + first)
            for e in group:
                yield parse(raw[e["offset"] - first : e["offset"] - first + e["length"]])


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the packages.

    Digests are computed from the content read; one that differs from the record's header is an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def rows(out: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                out = []
                for head, body in records(path):
                    said, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                    page = None if head["X-Page-ID"] == "None" else int(head["X-Page-ID"])
                    if kind == "response":
                        if hashlib.sha256(body).hexdigest() != said:
                            raise ValueError(f"digest of page {page} differs in {path}")
                        out.append((page, len(body), said, kind, None))
                    else:
                        out.append((page, int(head["X-Payload-Length"]), said, kind, int(head["WARC-Refers-To"][10:-1])))
                    if len(out) == 4096:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    return manifest.select("path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes all pages as records and reads them back, one row per page.

    A null or empty html is a response with no payload. Pages of equal payloads of at least `least` bytes revisit
    the one with the smallest page_id; shorter ones are all responses, and so are repeated rows of that page_id. A
    null page_id takes no part in revisits. An empty table gives no package and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    manifest = write(pages, scratch(spark, "warc"), least)
    n = max(1, spark.sparkContext.defaultParallelism)
    return read(manifest.repartition(4 * n))

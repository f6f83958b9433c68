"""WARC archives with a two-level capture index.

Operator 8.  Each task writes its records, one gzip member each, to archives in the
shared folder and returns their places; Spark's commit of that manifest decides
which archives count, so a lost or repeated task leaves at most unnamed files.  The
index sorts captures by reversed-host URL key (range partitions), packs LINES of
them to a compressed block, and keeps one directory row per block.  Reading goes
from a directory row to a range read of its block, and from a line to a range read
of its record; ``lookup`` binary-searches directory and block for one URL.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm._bitmaps import bitmap, held
from mnemospark.llm._shared import scratch, stored

#: Index lines in a block.
LINES = 1000
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
#: Files that a reading task keeps open.
HANDLES = 64
#: Tasks that read an archive back, at most.
READERS = 20_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "key string, page_id long, archive string, offset long, length long"
DIRECTORY = "part int, first_key string, last_key string, file string, offset long, length long, lines long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@dataclass
class Archive:
    """directory: a DataFrame of the sparse block directory."""

    folder: str
    directory: DataFrame


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query.  Without host, ``-)`` and the text."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return "-)" + quote(url or "", safe="/:?=&%")
    if not host:
        return "-)" + quote(url or "", safe="/:?=&%")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + quote((u.path or "/") + (f"?{u.query}" if u.query else ""), safe="/:?=&%")


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP header only, whose Content-Length is the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """The record of a gzip member; a response's digest is computed from its payload and must be the stated one."""
    data = zlib.decompress(raw, 31)
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda k: int(fields[k].removeprefix("<urn:x-page:").rstrip(">")) if k in fields else None
    kind = fields["WARC-Type"]
    if kind == "response":
        digest_of = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or digest_of != digest:
            raise ValueError(f"damaged record of page {number('WARC-Record-ID')}")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Writer:
    """A file of the shared folder, opened at the first write and named for nobody else."""

    def __init__(self, folder: str, kind: str):
        self.fs, self.folder = _fs(folder)
        self.kind, self.out, self.name, self.at = kind, None, "", 0

    def write(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}.{self.kind}", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        place = (self.name, self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Range reads of a folder's files; HANDLES of them stay open at most, and none after ``close``."""

    def __init__(self, folder: str):
        self.fs, self.folder = _fs(folder)
        self.files: dict = {}

    def range(self, name: str, offset: int, length: int) -> bytes:
        f = self.files.pop(name, None) or self.fs.open_input_file(f"{self.folder}/{name}")
        self.files[name] = f
        if len(self.files) > HANDLES:
            self.files.pop(next(iter(self.files))).close()
        return f.read_at(length, offset)

    def lines(self, name: str, offset: int, length: int) -> list[list]:
        """Of an index block."""
        return [json.loads(x) for x in zlib.decompress(self.range(name, offset, length)).decode().split("\n")]

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "warc.gz")
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("key", "page_id", "archive", "offset", "length")}
            cols = [b.column(c) for c in ("page_id", "url", "raw", "size", "digest", "refers_to")]
            for i in range(b.num_rows):
                page, url, raw, size, digest, to = (c[i].as_py() for c in cols)
                place = out.write(member(page, url, raw, base64.b32encode(bytes.fromhex(digest)).decode(), to, size))
                for k, v in zip(rows, (surt(url), page, *place), strict=True):
                    rows[k].append(v)
                if out.at > ARCHIVE_BYTES:
                    out.close()
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("key", "archive") else pa.int64()) for k, v in rows.items()})
        out.close()

    return run


def _blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, lines, found = _Writer(folder, "cdx.z"), [], []

        def flush():
            if lines:
                place = out.write(zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), LEVEL))
                found.append((TaskContext.get().partitionId(), lines[0][0], lines[-1][0], *place, len(lines)))
                lines.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length")), strict=True):
                lines.append(row)
                if len(lines) == LINES:
                    flush()
        flush()
        out.close()
        if found:
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ("part", "first_key", "last_key", "file", "offset", "length", "lines")
            yield pa.RecordBatch.from_pydict({n: pa.array(x, k) for n, k, x in zip(names, kinds, zip(*found, strict=True), strict=True)})

    return run


def write(pages: DataFrame, folder: str | None = None) -> Archive:
    """Archives and index of (page_id, url, html).

    Of records with equal payloads those with the largest page_id are responses, the
    others revisit it.  Null html is an empty payload; a null id or url is left out of
    the record; a row without id is a response only if its payload has no row with
    one; repeated rows are repeated records; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("size"), raw.alias("raw"))
    nobody = F.lit(None).cast("long").alias("refers_to")
    several = stored(rows.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "best"), "digests")
    bits = bitmap(several, F.col("digest"))
    # Payloads that surely come once are responses where they are.  Of the others the revisits need no payload, and responses are
    # looked up by page and digest, so that equal payloads don't meet in one task.
    once = held(rows, bits, F.col("digest"), wanted=False).select("page_id", "url", "digest", "size", "raw", nobody)
    rest = held(rows.drop("raw"), bits, F.col("digest")).join(several, "digest", "left")
    rest = stored(rest.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))).select("page_id", "url", "digest", "size", "refers_to"), "captures")
    revisits = rest.where("refers_to IS NOT NULL").select("page_id", "url", "digest", "size", F.lit(b"").alias("raw"), "refers_to")
    own = rest.where("refers_to IS NULL").select(F.col("page_id").alias("own"), F.col("digest").alias("of")).distinct()
    responses = held(rows, bits, F.col("digest")).join(own, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left_semi")
    rows = once.unionByName(revisits).unionByName(responses.withColumn("refers_to", nobody))
    manifest = stored(rows.select("page_id", "url", "raw", "size", "digest", "refers_to").mapInArrow(_archive(folder), MANIFEST), "manifest")
    directory = manifest.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset").mapInArrow(_blocks(folder), DIRECTORY)
    return Archive(folder, stored(directory, "directory"))


def read(archive: Archive, payloads: bool = True) -> DataFrame:
    """All records, by way of the index: one row each (payload null for revisits)."""
    folder = archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(_Reader(folder)) as reader:
            for b in batches:
                for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    lines = reader.lines(file, offset, length)
                    for i in range(0, len(lines), 200):
                        found = [parse(reader.range(*x[2:])) for x in lines[i : i + 200]]
                        if not payloads:
                            for x in found:
                                x["payload"] = None
                        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    # One row is a block of LINES records.  A stated number of partitions isn't coalesced, as the rows' few bytes would suggest.
    blocks = archive.directory.select("file", "offset", "length")
    return blocks.repartition(max(1, min(blocks.count(), READERS)), "file", "offset").mapInArrow(run, RECORD)


def lookup(spark: SparkSession, archive: Archive, url: str) -> list[dict]:
    """The records of one URL: binary search in the directory, then in the blocks that can hold its key."""
    key = surt(url)
    parts = archive.directory.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).where((F.col("lo") <= key) & (F.col("hi") >= key))
    own = [r["part"] for r in parts.collect()]  # the range partitions that the key falls in
    found = []
    with closing(_Reader(archive.folder)) as reader:
        for part in sorted(own):
            blocks = archive.directory.where(F.col("part") == part).orderBy("file", "offset").select("first_key", "last_key", "file", "offset", "length").collect()
            i = bisect.bisect_left([b["last_key"] for b in blocks], key)
            while i < len(blocks) and blocks[i]["first_key"] <= key:
                lines = reader.lines(*blocks[i][2:])
                keys = [x[0] for x in lines]
                found += [parse(reader.range(*x[2:])) for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
                i += 1
    return found


#: DuckDB's answer to op8.  A SHA-1 in hex is 160 bits, that is 32 base32 characters.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best, array_to_string(list_transform(range(1, 41), lambda i: format('{:04b}', strpos('0123456789abcdef', substr(x, i, 1)) - 1)), '') AS bits FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * (16 // CAST(pow(2, j) AS INT))))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM b
"""


def op8(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read(write(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Operator 2, WARC archives, written and read in splits.

*Writing.* A record for each page, each a gzip member of its own. Of pages with equal payloads of at least
``revisit_from`` bytes the one with the largest identifier is the response; the others are revisits that name
it and have no body, but keep the HTTP header with the payload's length. Equal payloads are found from digests,
without moving a page; only which pages are revisits is joined back, by identifier and digest, so copies
of one page don't meet in one task. A task writes a file under a name of its own, another one each time it's tried; the manifest, a table
that Spark commits, says which files count.

*Reading.* Files of the manifest (of archives without one, all files that end in .warc.gz) are cut into byte ranges, rows of a table that are dealt
to tasks. A task looks for the gzip magic from the start of its range,
takes a place for a member only if what begins there unpacks to a WARC version line, and from then on goes from
member to member. It owns the records that start inside its range, and reads past the end to finish the last
one. Bytes behind a range's first record that belong to no record that unpacks are stepped over to the next member, and come back as a
row of record_type ``damaged``: at is their place, payload_bytes their number inside the range. Payloads leave in
batches of bounded size, so memory is that of one record and a batch.

Defined results: a null page is the empty payload; a null identifier counts as smaller than any other, and is
written as no identifier at all; pages alike in identifier and payload are all responses or all revisits; an
empty table gives no files and no rows; a null address is left out, and bytes below 33 in one are percent-encoded; other columns aren't looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, scratch, ship, table, with_facts, written

SPLIT_BYTES = 1 << 25
CHUNK = 1 << 18
BATCH_BYTES = 1 << 24
RANGES = 1 << 17
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, at long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A page's record, unpacked."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if ord(c) > 32 else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!/)", "file:///", path)))


def with_revisits(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, html (bytes), refers_to, revisit."""
    rows = picked(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    digest = F.sha1("html")
    light = rows.where(F.octet_length("html") >= revisit_from).select("page_id", digest.alias("_digest"))
    groups, _ = written(light.groupBy("_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where((F.col("_n") > 1) & F.col("refers_to").isNotNull()), "page-digests")
    others = with_facts(light, groups, "_digest", "_n", pages.count()).where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))).distinct().select(F.col("page_id").alias("_other"), F.col("_digest").alias("_same"), "refers_to")
    full = rows.withColumn("_digest", digest)
    joined = full.join(others, full["page_id"].eqNullSafe(others["_other"]) & (full["_digest"] == others["_same"]), "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_warc(pages: DataFrame, path: str, revisit_from: int = 0) -> DataFrame:
    """Writes archives under ``path``, and their manifest, which it returns: file, bytes, records; a row for each task that had pages."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        store, root = _place(path)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            info = b"software: fellside\r\nformat: WARC File Format 1.1\r\n"
            size += sink.write(packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, name)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
            while first is not None:
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in first.columns), strict=True):
                    size += sink.write(packed(record(page_id, url, bytes(html), refers_to, revisit)))
                    records += 1
                first = next((b for b in batches if len(b)), None)
        yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [records]})

    made = with_revisits(pages, revisit_from).mapInArrow(write, "file string, bytes long, records long")
    made.write.parquet(f"{path}/{MANIFEST}")
    return pages.sparkSession.read.schema(made.schema).parquet(f"{path}/{MANIFEST}")


class _Window:
    """Bytes of a file from a place on, read in chunks."""

    def __init__(self, source, at: int):
        self.source, self.at, self.data = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        new = self.source.read(CHUNK)
        self.data += new
        return bool(new)

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n

    def is_record(self) -> bool:
        """Whether a member that begins here unpacks to the beginning of a WARC record."""
        while len(self.data) < 1024 and self.more():
            pass
        try:
            return self.data.startswith(MAGIC) and zlib.decompressobj(31).decompress(self.data[:1024], 7) == b"WARC/1."
        except zlib.error:
            return False

    def seek_record(self, end: int) -> bool:
        """Goes to the next record that starts before ``end``."""
        while True:
            i = self.data.find(MAGIC)
            if i < 0:
                keep = min(len(self.data), len(MAGIC) - 1)
                self.skip(len(self.data) - keep)
                if self.at >= end or not self.more():
                    return False
                continue
            self.skip(i)
            if self.at >= end:
                return False
            if self.is_record():
                return True
            self.skip(1)

    def member(self) -> bytes | None:
        """The member here, unpacked, and goes behind it; None, and goes one byte on, if it's damaged."""
        z, out = zlib.decompressobj(31), []
        taken, data = 0, self.data
        try:
            while True:
                out.append(z.decompress(data))
                taken += len(data) - len(z.unused_data)
                if z.eof:
                    self.data, self.at = z.unused_data, self.at + taken
                    return b"".join(out)
                data = self.source.read(CHUNK)
                if not data:
                    raise zlib.error("the file ends inside a member")
        except zlib.error:
            self.at += 1
            self.source.seek(self.at)
            self.data = b""
            return None


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def records(source, start: int, end: int) -> Iterator[tuple[int, dict | None, bytes | int]]:
    """Place, header fields and block of the records that start in [start, end); place, None and number of the bytes behind the first of these
    that belong to none."""
    w = _Window(source, start)
    after = None  # where the last record ended
    while w.seek_record(end):
        at = w.at
        data = w.member()
        if data is not None:
            if after is not None and at > after:
                yield after, None, at - after
            after = w.at
            yield at, *parsed(data)
    if after is not None and after < end:
        yield after, None, end - after


def splits(spark, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, start, stop (exclusive): a row for each byte range."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        files = spark.read.parquet(f"{path}/{MANIFEST}").select("file", "bytes")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    return files.where("bytes > 0").select("file", "bytes", lows.alias("start")).select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"))


def read_warc(spark, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records under ``path``, as ``SCHEMA``, and rows of damaged bytes; a response's digest is that of the payload
    that was read, and must be the one its header names."""
    ship(spark)
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("at", pa.int64())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(path)
        for b in batches:
            for name, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, size = [], 0
                with store.open_input_file(f"{root}/{name}") as source:
                    for at, fields, block in records(source, start, end):
                        if fields is None:
                            rows.append((None, None, "damaged", None, block, None, None, name, at))
                            continue
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                        if kind == "response" and (base32_sha1(payload) != named or len(payload) != length):
                            raise ValueError(f"{name}, byte {at}: the payload isn't the one that its record names")
                        number = lambda k, fields=fields: int(fields[k]) if k in fields else None
                        rows.append((number("page-id"), fields.get("warc-target-uri"), kind, number("refers-to-page-id"), length, named, payload if kind == "response" else None, name, at))
                        size += len(payload)
                        if size > BATCH_BYTES or len(rows) >= 1 << 14:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    # few rows stand for many bytes: a task for each, as far as RANGES goes; whoever is dealt several takes them one after the other
    ranges, _ = written(splits(spark, path, split_bytes), "warc-ranges")
    return ranges.repartition(min(max(1, ranges.count()), RANGES)).mapInArrow(read, SCHEMA)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).where("record_type <> 'damaged'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST((i // 8) * 10 + 1 AS INT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN g USING (h)
"""

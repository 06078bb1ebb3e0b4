"""WARC archives compressed record by record with an embedded Zstandard dictionary.

A dictionary is trained on a bounded sample of records and stands first in each
archive, in a skippable frame; every record is a frame of its own, so a reader
can start at any record's offset.  A payload of at least min_revisit bytes is stored once, by
the page with the smallest id; the other pages with it become revisit records that
refer to that one.

Archives are written by the tasks, straight to the shared folder: under a name of the
task's attempt first, and renamed when whole, so an attempt that is lost leaves nothing that
is read.  Only archives that finished attempts report are read back.

Defined cases: a null html is an empty payload; a null url is an empty target; control
characters in a url are percent-encoded; pages that share the smallest id of their payload are all
responses; null ids come last, and pages without any id to refer to are responses; an empty table
gives no archive and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tokens import pieces
from linkloom.session import shared_dir
from linkloom.sources.files import open_store

MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary in .warc.zst
_SHARES = 16
_SLICE_BYTES = 4 << 20  # of html that become Python objects at once


@dataclass(frozen=True)
class Archive:
    min_revisit: int = 100
    dictionary_bytes: int = 64 << 10
    sample_records: int = 500
    sample_bytes: int = 16 << 10
    level: int = 3
    max_archive_bytes: int = 1 << 30
    date: str = "2024-01-01T00:00:00Z"


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit without payload if it refers to another."""
    revisit = refers_to is not None
    http = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    fields["payload"] = None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    return fields


def train_dictionary(records: list[bytes], a: Archive) -> bytes:
    """A dictionary; with too few records to train one, their bytes themselves."""
    try:
        return zstandard.train_dictionary(a.dictionary_bytes, records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(records)[: a.dictionary_bytes]


def _dictionary(pages: DataFrame, a: Archive) -> bytes:
    """From sample_records pages, those with the least hash, each cut at sample_bytes for this purpose only.

    Hashes are ordered first, without the bodies, so that each task sends a few bytes a page to the driver.
    """
    placed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url").alias("place"))
    last = placed.select("place").orderBy("place").limit(a.sample_records).agg(F.max("place")).first()[0]
    if last is None:
        return b""
    start = F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, a.sample_bytes)
    rows = placed.where(F.col("place") <= last).select("page_id", "url", "place", start.alias("start")).limit(2 * a.sample_records).collect()
    rows.sort(key=lambda r: (r.place, r.page_id is None, r.page_id or 0, r.url or ""))
    return train_dictionary([record(r.page_id, r.url, bytes(r.start), hashlib.sha256(r.start).hexdigest(), len(r.start), None, a.date) for r in rows], a)


def typed(pages: DataFrame, a: Archive = Archive()) -> DataFrame:
    """page_id, url, html (null for revisits), digest, length and refers_to of each page.

    Payloads shared by several pages are found from light rows, summed before the shuffle.
    As one payload may be on a third of all pages, the join back is salted.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("length"))
    first = p.where(F.col("length") >= a.min_revisit).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("d", "first_id", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("share"))
    p = p.withColumn("share_of", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SHARES)).cast("int"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return (
        p.join(first, (F.col("digest") == F.col("d")) & (F.col("share_of") == F.col("share")), "left")
        .withColumn("refers_to", refers)
        .select("page_id", "url", F.when(F.col("refers_to").isNull(), F.coalesce("html", F.lit(""))).alias("html"), "digest", "length", "refers_to")
    )


def write_archives(pages: DataFrame, folder: str, a: Archive = Archive()) -> DataFrame:
    """Writes the archives and returns (path, records, bytes) of each, as a DataFrame that is computed already."""
    spark = pages.sparkSession
    dictionary = spark.sparkContext.broadcast(_dictionary(pages, a))  # at most dictionary_bytes
    store, top = open_store(folder)
    store.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        given = dictionary.value
        packed = zstandard.ZstdCompressor(level=a.level).compress(given)
        compressor = zstandard.ZstdCompressor(level=a.level, dict_data=zstandard.ZstdCompressionDict(given) if given else None)
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        out, n, size, number = None, 0, 0, 0
        for batch in batches:
            for r in (r for piece in pieces(batch, "html", _SLICE_BYTES) for r in piece.to_pylist()):
                if out is None:
                    name = f"{attempt}-{number:04d}"
                    out = store.open_output_stream(f"{top}/_{name}.tmp", compression=None)
                    size = out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
                payload = (r["html"] or "").encode()
                size += out.write(compressor.compress(record(r["page_id"], r["url"], payload, r["digest"], r["length"], r["refers_to"], a.date)))
                n += 1
                if size >= a.max_archive_bytes:
                    out.close()
                    store.move(f"{top}/_{name}.tmp", f"{top}/{name}.warc.zst")
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}.warc.zst", "records": n, "bytes": size}])
                    out, n, number = None, 0, number + 1
        if out is not None:
            out.close()
            store.move(f"{top}/_{name}.tmp", f"{top}/{name}.warc.zst")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}.warc.zst", "records": n, "bytes": size}])

    done = typed(pages, a).mapInArrow(write, "path string, records long, bytes long")
    # What is written outlives a lost executor only if it isn't written again: this table keeps the names.
    listing = f"{folder}/listing"
    done.write.parquet(listing)
    return spark.read.schema("path string, records long, bytes long").parquet(listing)


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, of which no more than a chunk and a record is held."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError("an archive must start with its dictionary")
    given = zstandard.ZstdDecompressor().decompress(stream.read(size))
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(given) if given else None)
    rest = b""
    while rest := rest or stream.read(chunk):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := stream.read(chunk)):
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records in the archives; response payloads are held against their digests and lengths."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = re.compile(r"<urn:page:(-?\d*)>")

        def of(x: str | None) -> int | None:
            return int(m[1]) if x and (m := number.fullmatch(x)) and m[1] else None

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = open_store(path)
                rows: list[dict] = []
                with store.open_input_stream(at, compression=None) as stream:
                    for data in frames(stream):
                        r = parse(data)
                        digest, length = r["WARC-Payload-Digest"].removeprefix("sha256:"), int(r["X-Payload-Length"])
                        if (p := r["payload"]) is not None:
                            if hashlib.sha256(p).hexdigest() != digest or len(p) != length:
                                raise ValueError(f"a payload in {path} does not match its digest")
                        rows.append({"page_id": of(r["WARC-Record-ID"]), "url": r["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": r["WARC-Type"], "refers_to": of(r.get("WARC-Refers-To"))})
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # One archive a task, as far as Spark's planning goes.
    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(tasks).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame, a: Archive = Archive()) -> DataFrame:
    """Writes all pages to archives in the shared folder and returns the records read back from them."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, a))

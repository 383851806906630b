"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent frames.  Each frame holds whole records, about
``FRAME_BYTES`` of them; a skippable frame maps record identifiers to (frame, offset in
the frame's content, length), and the seek table at the end, in the public seekable
format, gives each frame's size, its content's size and a checksum.  So one record is
read by opening one frame, while any Zstandard tool reads the whole file.

Bundles are rows of a Spark job, written by Spark's text writer, one a file: it works
on every file system that Spark does, and a lost task leaves no half a file behind.
That writer ends each row with a separator, which here is the last byte of the format.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage

FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
# Copies of one payload from which on its record is broadcast, not joined: there are at most rows / HOT such payloads.
HOT = 100_000

SEEK_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
FOOTER_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
LAST_BYTE = "\x8f"
PLACE = np.dtype([("id", "S16"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> bytes:
    """Sixteen bytes named by the page and its payload, so a revisit can name what it refers to."""
    return hashlib.md5(f"{page_id}\n{payload_digest}".encode()).digest()


def _urn(name: bytes) -> str:
    h = name.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """The address as one header line: control characters and blanks are escaped."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or f"urn:page:{page_id}"


def _framed(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, head: int | None, date: str) -> tuple[bytes, bytes]:
    """The identifier and the bytes of a page's record.  A revisit holds the answer's head alone, its payload's length included."""
    payload_digest = digest(payload)
    name = record_id(page_id, payload_digest)
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(name)), ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Page-Id", page_id)]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(record_id(head, payload_digest))), ("Refers-To-Page-Id", head)]
    return name, _framed(headers, answer if revisit else answer + payload)


def _checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class Bundle:
    """A file being written: records go in, frames come out."""

    def __init__(self, name: bytes, date: str):
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.seeks: list[tuple[int, int, int]] = []
        self.places: list[tuple[bytes, int, int, int]] = []
        self.open, self.held, self.size = [], 0, 0
        self.add(None, _framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(name)), ("WARC-Date", date),
                                ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, name: bytes | None, record: bytes) -> None:
        # Records are not split, so one longer than a frame has its own; offsets have 32 bits, as the format's sizes.
        if self.open and self.held + len(record) > FRAME_BYTES:
            self.close_frame()
        if name is not None:
            self.places.append((name, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)

    def close_frame(self) -> None:
        content = b"".join(self.open)
        self._keep(self.packer.compress(content), len(content), _checksum(content))
        self.open, self.held = [], 0

    def _keep(self, frame: bytes, content: int, checksum: int) -> None:
        self.frames.append(frame)
        self.seeks.append((len(frame), content, checksum))
        self.size += len(frame)

    def close(self) -> bytes:
        if self.open:
            self.close_frame()
        places = np.sort(np.array(self.places, PLACE), order=["id", "frame", "offset"]).tobytes()
        self._keep(struct.pack("<II", INDEX_MAGIC, len(places)) + places, 0, _checksum(b""))
        table = b"".join(struct.pack("<III", *seek) for seek in self.seeks) + struct.pack("<IBI", len(self.seeks), WITH_CHECKSUMS, FOOTER_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SEEK_MAGIC, len(table)) + table


def frames_of(bundle: bytes | memoryview) -> list[tuple[int, int, int, int]]:
    """``(start, size, content size, checksum)`` of each frame, from the seek table alone."""
    many, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER_MAGIC or flags != WITH_CHECKSUMS:
        raise ValueError("no seek table at the end")
    start, out = 0, []
    for size, content, checksum in struct.iter_unpack("<III", bundle[len(bundle) - 9 - 12 * many:len(bundle) - 9]):
        out.append((start, size, content, checksum))
        start += size
    return out


def places_of(bundle: bytes | memoryview, frames: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The map of record identifiers, in their order: the last frame of the table."""
    start, size, _, _ = frames[-1]
    magic, length = struct.unpack("<II", bundle[start:start + 8])
    if magic != INDEX_MAGIC or length != size - 8:
        raise ValueError("no map of records before the seek table")
    return np.frombuffer(bundle[start + 8:start + size], PLACE)


def content_of(frame: bytes | memoryview, size: int, checksum: int) -> bytes:
    content = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size)
    if len(content) != size or _checksum(content) != checksum:
        raise ValueError("a frame's content is not what the seek table says")
    return content


def parse(content: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-case name, block, and the next record's offset."""
    stop = content.index(b"\r\n\r\n", offset)
    first, *lines = content[offset:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {offset}")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    end = stop + 4 + int(headers["content-length"])
    return headers, content[stop + 4:end], end + 4


READ = ("page_id long, url string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long, "
        "payload binary")


def _page(headers: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    said, revisit = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"{headers['warc-record-id']}: the payload is not the one its digest names")
    number = {name: int(headers[name]) if name in headers else None for name in ("page-id", "refers-to-page-id")}
    return {"page_id": number["page-id"], "url": headers["warc-target-uri"], "record_type": headers["warc-type"],
            "record_id": headers["warc-record-id"], "payload_bytes": length, "payload_digest": said,
            "refers_to": number["refers-to-page-id"], "payload": None if revisit else payload}


def with_heads(pages: DataFrame, least: int) -> DataFrame:
    """``page_id, url, payload, revisit, head``: the page that a copy's record refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    groups = cut_lineage(rows.where(large).groupBy("key").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = groups.where(F.col("n") > HOT).select("key", F.col("head").alias("hot_head"), F.lit(True).alias("hot"))
    rest = groups.where(F.col("n") <= HOT).select(F.col("key").alias("own"), "head", F.lit(True).alias("copied"))
    # A hot or small payload has its head already, or needs none: its rows are spread by a key that nothing meets.
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    met = rows.join(F.broadcast(hot), "key", "left").withColumn("own", F.when(F.col("hot").isNotNull() | ~large, alone).otherwise(F.col("key")))
    met = met.join(rest.hint("merge"), "own", "left")
    head = F.coalesce("hot_head", "head")
    copied = F.col("hot").isNotNull() | F.col("copied").isNotNull()
    return met.select("page_id", "url", "payload", (copied & ~head.eqNullSafe(F.col("page_id"))).alias("revisit"), head.alias("head"))


def write_archives(pages: DataFrame, path: str, *, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row of ``page_id, url, html`` to bundles in ``path``.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest id
    is a response and the others revisit it.  Rows that share that smallest id are all
    responses; rows of one id and payload share a record identifier.  A null html is an
    empty payload, a null address is written as ``urn:page:<id>``, control characters in
    addresses are escaped.  A null id is larger than all others: its record has no page id, and
    where every copy's id is null all are responses.  Other columns are not written.
    An empty table writes no bundle.

    A worker holds one bundle, the largest a single record, of at most 2 GB.  Any number of copies
    of one payload may occur: those of more than ``HOT`` rows are told apart without a shuffle by
    payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                page_id, url, payload, revisit, head = (c[k].as_py() for c in columns)
                name, record = page_record(page_id, url, payload, revisit, head, date)
                if bundle is not None and bundle.size + len(record) // 2 > BUNDLE_BYTES and bundle.places:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.close()[:-1]], pa.binary())], ["bundle"])
                    bundle = None
                if bundle is None:
                    bundle = Bundle(hashlib.md5(f"{path}\n{part}\n{number}".encode()).digest(), date)
                    number += 1
                bundle.add(name, record)
        if bundle is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.close()[:-1]], pa.binary())], ["bundle"])

    bundles = with_heads(pages, least).mapInArrow(run, "bundle binary")
    bundles.select(F.col("bundle").cast("string")).write.options(
        maxRecordsPerFile="1", compression="none", encoding="ISO-8859-1", lineSep=LAST_BYTE).text(path)


def _bundles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every page's record: ``READ``.  Frames' checksums and payloads' digests are checked; a revisit has a null ``payload``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bundle = memoryview(batch.column(1)[k].as_buffer())
                for start, size, length, checksum in frames_of(bundle)[:-1]:
                    content, at, found = content_of(bundle[start:start + size], length, checksum), 0, []
                    while at < len(content):
                        headers, block, at = parse(content, at)
                        if headers["warc-type"] != "warcinfo":
                            found.append(_page(headers, block))
                    yield _rows(found)

    return _bundles(spark, path).mapInArrow(run, READ)


def _rows(found: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return pa.RecordBatch.from_pylist(found, schema=pa.schema([(name, kinds[kind]) for name, kind in map(str.split, READ.split(", "))]))


def record_places(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, file, start, size, content, checksum, offset, length`` of every page's record: where its frame lies in the file,
    and where the record lies in the frame's content.  No frame is opened."""
    schema = "record_id string, file string, start long, size long, content long, checksum long, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bundle = memoryview(batch.column(1)[k].as_buffer())
                frames = frames_of(bundle)
                places = places_of(bundle, frames)
                of = np.array(frames, np.int64).reshape(-1, 4)[places["frame"]]
                # A numpy string drops zeros at its end.
                names = [_urn(name.ljust(16, b"\0")) for name in places["id"].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array([batch.column(0)[k].as_py()] * len(names)), *(pa.array(of[:, j]) for j in range(4)),
                     pa.array(places["offset"].astype(np.int64)), pa.array(places["length"].astype(np.int64))],
                    [field.split()[0] for field in schema.split(", ")])

    return _bundles(spark, path).mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str | list[str], places: DataFrame) -> DataFrame:
    """The records at some of ``record_places``: ``READ``.

    Only the frames that hold them leave the file scan, each once, and only they are
    opened.  ``path`` may be the list of files that hold them, so that no other is read.
    """
    frame = ["file", "start", "size", "content", "checksum"]
    wanted = places.select(*frame, F.struct("offset", "length").alias("at")).groupBy(*frame).agg(F.collect_set("at").alias("at"))
    cut = F.expr("substring(bytes, cast(start + 1 as int), cast(size as int))")
    held = _bundles(spark, path).withColumnRenamed("content", "bytes").join(wanted, "file").select("content", "checksum", "at", cut.alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = content_of(row["frame"], row["content"], row["checksum"])
                yield _rows([_page(*parse(content, at["offset"])[:2]) for at in row["at"]])

    return held.mapInArrow(run, READ)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head
  FROM pages),
digits AS (  -- base32 takes five bits at a time: the n-th of 32 begins at bit 5n
  SELECT page_id, html, head, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex || '00', (5 * n) // 4 + 1, 3))::INTEGER >> (7 - (5 * n) % 4)) & 31) + 1, 1), '' ORDER BY n) AS payload_digest
  FROM p, range(32) AS bits(n) GROUP BY ALL)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM digits
"""

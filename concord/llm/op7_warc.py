"""WARC archives compressed record by record with a dictionary of their own.

Each archive is a .warc.zst file: a leading skippable frame that holds the Zstandard
dictionary trained on the archive's first records, then one Zstandard frame per record.
Records whose payload another record has are revisits. Archives are written to the folder
that driver and executors share under names no other task attempt uses; the manifest, a
table, names the files of the attempts that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.plans.shared import cut, new_path

#: Fixed values of the formats.
SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records the dictionary is trained on, its size, and an archive's payload bytes.
TRAIN_BYTES, DICT_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 128 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; control characters and spaces of the URL are percent-encoded."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary of at most DICT_BYTES; the records' own bytes where there are too few to train on."""
    total = sum(map(len, records))
    if total < 2 * DICT_BYTES or len(records) < 16:
        return b"".join(records)[:DICT_BYTES] if total >= 8 else b""
    try:
        return zstd.train_dictionary(DICT_BYTES, records, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(records)[:DICT_BYTES]


class ArchiveWriter:
    """Writes records to one archive; holds back the first TRAIN_BYTES until the dictionary is built."""

    def __init__(self, out) -> None:
        self.out, self.held, self.size, self.records, self.written = out, [], 0, 0, 0
        self.packer: zstd.ZstdCompressor | None = None

    def add(self, rec: bytes) -> None:
        self.records, self.size = self.records + 1, self.size + len(rec)
        if self.packer is None:
            self.held.append(rec)
            if self.size >= TRAIN_BYTES:
                self._start()
        else:
            self._put(self.packer.compress(rec))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        data = train(self.held)
        if data:
            known = zstd.ZstdCompressionDict(data)
            self.packer = zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
            packed = zstd.ZstdCompressor(level=12).compress(data)
            self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        else:
            self.packer = zstd.ZstdCompressor(level=LEVEL, write_checksum=True)
        for rec in self.held:
            self._put(self.packer.compress(rec))
        self.held = []

    def close(self) -> None:
        if self.packer is None:
            self._start()
        self.out.close()


def read_archive(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, one in memory at a time."""
    head = raw.read(8)
    known, start = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        data, start = raw.read(struct.unpack("<I", head[4:])[0]), b""
        if struct.unpack("<I", data[:4])[0] == ZSTD_MAGIC:
            data = zstd.ZstdDecompressor().decompress(data, max_output_size=16 << 20)
        known = zstd.ZstdCompressionDict(data)
    source = _Chained(start, raw)
    stream = io.BufferedReader(zstd.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


class _Chained:
    def __init__(self, first: bytes, rest) -> None:
        self.first, self.rest = first, rest

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first[: n if n >= 0 else None], self.first[n:] if n >= 0 else b""
            return out
        return self.rest.read(n) if n >= 0 else self.rest.read()


MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, done = TaskContext.get(), []
        now: ArchiveWriter | None = None

        def close() -> None:
            now.close()
            done.append((name, now.records, now.written))

        for batch in batches:
            for page_id, url, page, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}.warc.zst"
                    now = ArchiveWriter(fs.open_output_stream(f"{base}/{name}"))
                now.add(record(page_id, url, (page or "").encode(), winner, page_id != winner))
                if now.size >= ARCHIVE_BYTES:
                    close()
                    now = None
        if now is not None:
            close()
        names, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record to archives in folder; the manifest (archive, records, bytes), written once.

    Of rows with equal payloads that with the largest id is the response, the others revisit
    it. The winner is found by an aggregation over digests; the join back is an equi-join
    that adaptive execution splits where one payload holds many rows. Null html is an empty
    payload; a null id revisits any other id's equal payload; rows repeated with the winning
    id are all responses; an empty table gives an empty manifest.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    p = p.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    winners = p.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("winner"))
    rows = p.join(winners, p.digest == winners.d).select("page_id", "url", "html", "winner")
    return cut(rows.mapInArrow(_writer(folder), MANIFEST), "warc-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def rows(path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(at) as raw:
            for h, block in read_archive(raw):
                if h["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and (len(payload) != size or digest32(payload) != digest):
                    raise ValueError(f"{path}: a payload differs from its digest")
                yield (int(h["page-id"]) if "page-id" in h else None, h.get("warc-target-uri"), size, digest, h["warc-type"], int(h["refers-to-page-id"]) if "refers-to-page-id" in h else None, path)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            out: list[tuple] = []
            for row in rows(path):
                out.append(row)
                if len(out) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per response or revisit record of the manifest's archives, payloads checked against their digests; a task for each archive."""
    n = manifest.count()
    return manifest.select("archive").repartitionByRange(max(1, n), "archive").mapInArrow(_read, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, new_path(spark, "warc"))
    return read_archives(manifest).drop("url", "archive")

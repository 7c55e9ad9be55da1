"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

File layout: a skippable frame of magic ``184D2A5D`` whose content is the dictionary (itself a
Zstandard frame, or bare), then one compressed frame for each record.  ``ArchiveReader`` decodes a
frame at a time, so memory is bounded by the largest record, and refuses what does not hold: a bad
version line, a missing or repeated mandatory header, a block whose length differs from
``Content-Length``, a missing record end, a payload whose length or digest differs from its header.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rundelta.llm.common import file_system, lean, materialize, ready, shared_dir, write_bytes

SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary of ``DICTIONARY_BYTES`` is trained on the first ``DICTIONARY_SAMPLES`` payloads of a file.
DICTIONARY_BYTES, DICTIONARY_SAMPLES, SAMPLE_BYTES = 32 * 1024, 200, 16 * 1024
#: Bytes of compressed records in a file; a worker holds no more of them.
ARCHIVE_BYTES = 64 * 1024 * 1024
#: The one header of a record that may be there several times.
REPEATABLE = "warc-concurrent-to"


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


class Headers(dict):
    """Header values by name, in any case of letters."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


@dataclass(frozen=True)
class Record:
    headers: Headers
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]

    @property
    def http(self) -> tuple[Headers, bytes]:
        """HTTP headers and payload of the block."""
        head, found, payload = self.block.partition(b"\r\n\r\n")
        if not found:
            raise ArchiveError("block without an end of HTTP headers")
        return _fields(head.split(b"\r\n")[1:], "HTTP"), payload


def _fields(lines: list[bytes], where: str) -> Headers:
    """Repeated fields of HTTP, and those that WARC lets repeat, are one list."""
    out = Headers()
    for line in lines:
        name, found, value = line.partition(b":")
        if not found or not name.strip():
            raise ArchiveError(f"{where}: not a header line: {line[:60]!r}")
        key, text = name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip()
        if key in out and where == "WARC" and key != REPEATABLE:
            raise ArchiveError(f"{where}: {key} occurs twice")
        out[key] = f"{out[key]}, {text}" if key in out else text
    return out


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def encode_record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit whose block has the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {_clean(uri or 'urn:none')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> Record:
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("record without an end of headers")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError(f"unknown version {version[:20]!r}")
    headers = _fields(lines, "WARC")
    for k in MANDATORY:
        if not headers.get(k):
            raise ArchiveError(f"no {k}")
    if not headers["Content-Length"].isdigit():
        raise ArchiveError("Content-Length is no number")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes; Content-Length is {n}")
    return Record(headers, rest[:n])


def make_dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else the first bytes of the samples."""
    samples = [s[:SAMPLE_BYTES] for s in samples[:DICTIONARY_SAMPLES] if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + b"".join(samples))[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Records, compressed as they come; ``chunks()`` are the file's bytes."""

    def __init__(self, dictionary: bytes):
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        self.head, self.frames, self.size = struct.pack("<II", SKIPPABLE, len(packed)) + packed, [], 0

    def add(self, record: bytes) -> None:
        self.frames.append(self.compressor.compress(record))
        self.size += len(self.frames[-1])

    def chunks(self) -> Iterator[bytes]:
        yield self.head
        yield from self.frames


def archive_chunks(dictionary: bytes, records: list[bytes]) -> Iterator[bytes]:
    writer = ArchiveWriter(dictionary)
    for r in records:
        writer.add(r)
    return writer.chunks()


class ArchiveReader:
    """Iterates the records of an archive; ``handle`` has ``read(n)``."""

    def __init__(self, handle, chunk: int = 1 << 18):
        self.handle, self.chunk = handle, chunk
        head = handle.read(8)
        if len(head) < 8:
            raise ArchiveError("too short for a skippable frame")
        magic, size = struct.unpack("<II", head)
        if magic != SKIPPABLE:
            raise ArchiveError("no leading skippable frame with a dictionary")
        raw = handle.read(size)
        if len(raw) != size:
            raise ArchiveError("truncated dictionary")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))

    def __iter__(self) -> Iterator[Record]:
        left = b""
        while True:
            if not left:
                left = self.handle.read(self.chunk)
                if not left:
                    return
            frame, parts = self.decompressor.decompressobj(), []
            while not frame.eof:
                try:
                    parts.append(frame.decompress(left))
                except zstandard.ZstdError as e:
                    raise ArchiveError(f"damaged frame: {e}") from e
                left = frame.unused_data if frame.eof else self.handle.read(self.chunk)
                if not frame.eof and not left:
                    raise ArchiveError("truncated frame")
            yield decode_record(b"".join(parts))


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])


def _writer(folder: str):
    def write(batches):
        import uuid

        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def close(archive):
            path = f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.warc.zst"
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": len(archive.frames), "n_bytes": write_bytes(path, archive.chunks())}])

        archive = None
        for batch in batches:
            rows = batch.to_pydict()
            payloads = [x.encode("utf-8", "surrogatepass") for x in rows["payload"]]
            for page_id, uri, payload, digest, target in zip(rows["page_id"], rows["url"], payloads, rows["digest"], rows["target"], strict=True):
                archive = archive or ArchiveWriter(make_dictionary(payloads))
                again = target is not None and target != page_id
                archive.add(encode_record("revisit" if again else "response", f"urn:page:{page_id}", uri, payload, digest, f"urn:page:{target}" if again else None))
                if archive.size >= ARCHIVE_BYTES:
                    yield close(archive)
                    archive, seq = None, seq + 1
        if archive:
            yield close(archive)

    return write


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Write a record per page; returns the manifest (path, n_records, n_bytes).

    Of pages with equal payloads (same SHA-1 and length) of at least ``revisit_bytes`` bytes, that with
    the largest identifier is a response and the others revisit it.  The largest identifier is a
    partial aggregate and comes back by a left join on the digest, whose hot keys adaptive execution
    splits; only digests that occur twice are joined, and smaller payloads, which may all be one, are
    spread by a hash of their own.

    Null html is an empty payload; null urls are written as ``urn:none``; rows with a null identifier
    revisit the group's largest one and are responses where the group has none; of repeated rows that
    carry the largest identifier each is a response; an empty table gives an empty manifest.
    """
    spark = ready(pages.sparkSession)
    folder = folder or shared_dir(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1").select(F.concat_ws(":", "digest", "size").alias("same"), "target")
    own = F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("same", F.when(F.col("size") >= revisit_bytes, F.concat_ws(":", "digest", "size")).otherwise(own))
    rows = rows.join(groups, "same", "left").select("page_id", "url", "payload", "digest", "target")
    return materialize(rows.mapInArrow(lean(_writer(folder)), MANIFEST), "warc-manifest")


def _page(record_id: str) -> int | None:
    kept = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if kept == "None" else int(kept)


def _reader(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = file_system(row["path"])
            found, n = [], 0
            with fs.open_input_stream(path, compression=None) as handle:
                for r in ArchiveReader(handle):
                    http, payload = r.http
                    size, digest = int(http["Content-Length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r.kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ArchiveError(f"{path}: payload of {r.headers['WARC-Record-ID']} differs from its headers")
                    if r.kind == "revisit" and payload:
                        raise ArchiveError(f"{path}: revisit with a payload")
                    target = r.headers.get("WARC-Refers-To")
                    found.append({"page_id": _page(r.headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": r.kind, "refers_to": _page(target) if target else None, "url": r.headers["WARC-Target-URI"]})
                    n += 1
                    if len(found) == 5000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
            if n != row["n_records"]:
                raise ArchiveError(f"{path}: {n} records; {row['n_records']} were written")
            yield pa.RecordBatch.from_pylist(found, schema=schema)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read every record back, validated: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    files = [(r["path"], r["n_records"]) for r in manifest.select("path", "n_records").collect()]
    listed = spark.createDataFrame(files, "path string, n_records long").repartition(max(1, len(files)))
    return listed.mapInArrow(lean(_reader), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")

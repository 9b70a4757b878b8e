"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes the records of its rows to archives of at most ARCHIVE_BYTES of
uncompressed records. The dictionary of an archive is trained on its first records. A file's
name holds the attempt that wrote it and only a task that ends well reports its files, so
retried and speculative tasks leave no record twice. Reading: each archive is one row of the
manifest; its frames are decoded one at a time, so a task holds one record. Every record's
version, named headers, block length and payload digest are validated, and a bad archive raises
ValueError.

Which page is the response of a group of equal payloads is decided on digests. The groups with
two members or more are written to the shared folder first, so Spark knows their size and
broadcasts them only below its threshold; else the join shuffles, and adaptive execution splits
a group that holds many pages.

Cases. Null html: an empty payload. Null page_id: written as such, and read as null; a group
that has only null ids is all response. Pages that repeat the smallest id of their group are
responses too. Null url: no target URI. Empty table: no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_dir, staged

DICTIONARY_FRAME, DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
NEEDED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
LEVEL, DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 3, 16384, 128, 4096
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
DATE = b"2024-01-01T00:00:00Z"
ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def name_of(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def id_of(name: bytes) -> int | None:
    if not (name.startswith(b"<urn:page:") and name.endswith(b">")):
        raise ValueError(f"not a page's name: {name!r}")
    return None if name == b"<urn:page:none>" else int(name[10:-1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """The bytes of one record; a revisit has the HTTP header, with the payload's length, alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + name_of(page_id), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    if kind == "revisit":
        head += [b"WARC-Refers-To: " + name_of(refers_to), b"WARC-Profile: " + PROFILE]
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the beginnings of some records; None where they are too few or too alike."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_BYTES] for r in records])
    except zstandard.ZstdError:
        return None


def write_archive(out, records: Iterator[bytes]) -> tuple[int, bool]:
    """Write records until ARCHIVE_BYTES are passed: how many, and if all were written."""
    first = list(islice(records, SAMPLE_RECORDS))
    known = trained(first)
    if known is not None:
        content = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known) if known is not None else zstandard.ZstdCompressor(level=LEVEL)
    n = size = 0
    for r in chain(first, records):
        out.write(packer.compress(r))
        n, size = n + 1, size + len(r)
        if size >= ARCHIVE_BYTES and n >= len(first):
            return n, False
    return n, True


class Archive:
    """Reads the records of an archive, frame by frame."""

    def __init__(self, source):
        self.source, self.buffer = source, b""

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            more = self.source.read(max(CHUNK, n - len(self.buffer)))
            if not more:
                return False
            self.buffer += more
        return True

    def dictionary(self) -> zstandard.ZstdCompressionDict | None:
        """What the leading skippable frame holds: a dictionary, bare or as a frame of its own."""
        if not self.fill(8) or struct.unpack("<I", self.buffer[:4])[0] != DICTIONARY_FRAME:
            return None
        size = struct.unpack("<I", self.buffer[4:8])[0]
        if not self.fill(8 + size):
            raise ValueError("the dictionary is cut off")
        content, self.buffer = self.buffer[8 : 8 + size], self.buffer[8 + size :]
        magic = struct.unpack("<I", content[:4])[0] if size >= 4 else None
        if magic == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        elif magic != DICTIONARY_MAGIC:
            raise ValueError("the leading frame holds no dictionary")
        return zstandard.ZstdCompressionDict(content)

    def records(self) -> Iterator[bytes]:
        known = self.dictionary()
        reader = zstandard.ZstdDecompressor(dict_data=known) if known is not None else zstandard.ZstdDecompressor()
        while self.fill(4) or self.buffer:
            if len(self.buffer) < 4:
                raise ValueError("bytes after the last frame")
            magic = struct.unpack("<I", self.buffer[:4])[0]
            if magic in SKIPPABLE:
                if not self.fill(8) or not self.fill(8 + struct.unpack("<I", self.buffer[4:8])[0]):
                    raise ValueError("a skippable frame is cut off")
                self.buffer = self.buffer[8 + struct.unpack("<I", self.buffer[4:8])[0] :]
                continue
            if magic != ZSTD_MAGIC:
                raise ValueError(f"not a frame: {self.buffer[:4].hex()}")
            frame, parts = reader.decompressobj(), []
            while not frame.eof:
                if not self.buffer and not self.fill(1):
                    raise ValueError("a frame is cut off")
                parts.append(frame.decompress(self.buffer))
                self.buffer = frame.unused_data
            yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """A record as a row of ROW. ValueError if it is not valid."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
    if version != VERSION or not mark:
        raise ValueError(f"not a WARC record: {data[:20]!r}")
    if missing := [k for k in NEEDED if k not in fields]:
        raise ValueError(f"headers are missing: {missing}")
    n = int(fields[b"content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes; its header says {n}")
    http, mark, payload = rest[:n].partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    scheme, _, digest = fields.get(b"warc-payload-digest", b"").partition(b":")
    kind = fields[b"warc-type"]
    if not mark or len(lengths) != 1 or scheme != b"sha256" or kind not in (b"response", b"revisit"):
        raise ValueError(f"a {kind!r} record has no HTTP header, length or digest")
    if kind == b"response" and (len(payload) != lengths[0] or hashlib.sha256(payload).hexdigest().encode() != digest):
        raise ValueError("a payload does not match its length or digest")
    url = fields.get(b"warc-target-uri")
    return {
        "page_id": id_of(fields[b"warc-record-id"]), "url": None if url is None else url.decode(), "payload": payload if kind == b"response" else None,
        "payload_bytes": lengths[0], "payload_digest": digest.decode(), "record_type": kind.decode(), "refers_to": id_of(fields[b"warc-refers-to"]) if kind == b"revisit" else None,
    }


def written(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below the folder; their manifest: path, records."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("payload") >= MIN_REVISIT
    groups = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = staged(groups.select("digest", "first"), "payload-groups")
    own = groups.withColumnRenamed("digest", "group_digest")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(own, F.col("digest") == F.col("group_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        records = (record(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        attempt, k, more = uuid.uuid4().hex, 0, True
        while more:
            head = next(records, None)
            if head is None:
                break
            name = f"{attempt}-{k:05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                n, ended = write_archive(out, chain([head], records))
            k, more = k + 1, not ended
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in the column path. Without payloads they are validated and left out."""
    fields = [f for f in ROW if payloads or f.name != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = opened(path)
                with store.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for r in map(parsed, Archive(source).records()):
                        size += len(r["payload"] or b"") if payloads else 200
                        rows.append(r)
                        if size > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in rows], f.type) for f in fields], [f.name for f in fields])
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in rows], f.type) for f in fields], [f.name for f in fields])

    types = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return manifest.select("path").mapInArrow(run, ", ".join(f"{f.name} {types[f.type]}" for f in fields))


def archived(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    manifest = staged(written(pages.select("page_id", "url", "html"), fresh_dir(spark, "warc")), "manifest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read(manifest.repartition(tasks), payloads)

"""WARC archives as seekable Zstandard bundles, with an index of record offsets within frames."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import file_system, shared_dir, slices, tasks_for, written

#: Fixed values of the seekable format: the seek table's skippable frame, its footer, and its descriptor (checksums present).
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30
#: Frames that are read one after the other, and bytes of records that a task reads.
STRETCH, READ_BYTES = 8, 1 << 25
INDEX = "page_id long, archive string, frame int, at int, size int"


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    payload: bytes | None
    payload_bytes: int
    digest: str
    refers_to: int | None = None


def encode(r: Record, date: str) -> bytes:
    """A record's bytes; a revisit has the headers of its HTTP block alone."""
    revisit = r.refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + r.payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if r.page_id is None else r.page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', r.url)}"] if r.url else []),
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{r.refers_to}>"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(r.digest)).decode()}",
        f"X-Payload-Length: {r.payload_bytes}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(raw: bytes) -> Record:
    """The record that ``raw`` is; an error if it is damaged or its payload has another digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record of another length")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(x) if (x := re.search(r"urn:x-page:(-?\d*)", fields.get(name, ""))) and (x := x[1]) else None
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload of another digest")
    size = int(fields["X-Payload-Length"]) if payload is None else len(payload)
    return Record(number("WARC-Record-ID"), fields.get("WARC-Target-URI"), payload, size, digest, number("WARC-Refers-To"))


class BundleWriter:
    """Writes independent frames of about ``frame_bytes`` and, on closing, the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        if not 0 < frame_bytes < 1 << 32:
            raise ValueError("the seek table has 32 bits for the size of a frame")
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """The frame and the offset in it at which ``raw`` will stand; a record that is larger than a frame has one of its own."""
        if len(raw) >= 1 << 31:
            raise ValueError("a record of 2 GiB or more")
        if self.size and self.size + len(raw) > self.frame_bytes:
            self.flush()
        at = self.size
        self.held.append(raw)
        self.size += len(raw)
        return len(self.frames), at

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size, self.total = [], 0, self.total + len(packed)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames by the seek table."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != DESCRIPTOR:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.frames, at = [], 0
        for packed, plain, checksum in struct.iter_unpack("<III", source.read(12 * n)):
            self.frames.append((at, packed, plain, checksum))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain, checksum = self.frames[i]
        self.source.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return raw


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives below ``folder``; the index (page_id, archive, frame, at, size), as a table.

    Of rows with equal payloads of at least ``min_revisit`` bytes the one with the largest id is a
    response and the others revisit it; rows that share that id, and rows without any id, are all
    responses. Digests with more than one row are found from digests alone; the payloads then move
    at most once, in a join that adaptive execution splits where a digest is hot.

    Each attempt of a task writes files of its own; the index names only those of attempts that
    ended well, so lost executors leave nothing that is read. A null payload is empty, a null url is left out, a
    null id has an empty record id. Repeated rows have a record each; other columns may have any names. A record of
    2 GiB or more raises. An empty table gives an empty index and no archives.
    """
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"), F.sha1(raw).alias("digest"))
    shared = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    shared = shared.where("n > 1 and kept is not null").select(F.col("digest").alias("same"), "kept")
    joined = rows.join(shared, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= min_revisit), "left")
    first = F.col("kept").isNull() | F.col("page_id").eqNullSafe(F.col("kept"))
    ready = joined.select("page_id", "url", F.when(first, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), "digest", F.when(~first, F.col("kept")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store, writer, n, name = TaskContext.get(), None, None, 0, ""
        for batch in slices(batches, 64):
            out = []
            for row in batch.to_pylist():
                if writer is None:
                    store, path = file_system(folder)
                    store.create_dir(path, recursive=True)
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{n}.warc.zst"
                    writer, n = BundleWriter(store.open_output_stream(f"{path}/{name}", compression=None), frame_bytes), n + 1
                raw = encode(Record(**row), date)
                frame, at = writer.add(raw)
                out.append((row["page_id"], f"{folder}/{name}", frame, at, len(raw)))
                if writer.total >= archive_bytes:
                    writer.close()
                    writer = None
            if out:
                ids, names, *numbers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), *[pa.array(x, pa.int32()) for x in numbers]], names=["page_id", "archive", "frame", "at", "size"])
        if writer is not None:
            writer.close()

    return written(ready.mapInArrow(run, INDEX))


def read_archives(index: DataFrame) -> DataFrame:
    """The records that ``index`` names: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Stretches of frames are dealt over as many tasks as their bytes ask for; each frame is found by its archive's seek
    table, unpacked once and cut at the records' offsets. A record of another id than the index has is an error.
    An empty index gives no rows.
    """
    total = index.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    stretches = index.withColumn("stretch", F.floor(F.col("frame") / STRETCH)).repartition(tasks_for(index.sparkSession, total, READ_BYTES), "archive", "stretch")
    frames = stretches.groupBy("archive", "stretch", "frame").agg(F.collect_list(F.struct("at", "size", "page_id")).alias("records")).drop("stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        opened: tuple[str, BundleReader] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if opened is None or opened[0] != row["archive"]:
                    store, path = file_system(row["archive"])
                    opened = row["archive"], BundleReader(store.open_input_file(path))
                raw, out = opened[1].frame(row["frame"]), []
                for x in row["records"]:
                    r = decode(raw[x["at"] : x["at"] + x["size"]])
                    if r.page_id != x["page_id"]:
                        raise ValueError(f"{row['archive']}: {r.page_id} stands where the index has {x['page_id']}")
                    out.append((r.page_id, r.url, r.payload, r.payload_bytes, r.digest, "response" if r.payload is not None else "revisit", r.refers_to))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ordered = frames.sortWithinPartitions("archive", "frame")
    return ordered.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` into a new folder of the shared checkpoint folder and reads the records back."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession), **options))

"""WARC archives in seekable Zstandard bundles.

Records are put together to frames of about FRAME_BYTES, each compressed by itself; an archive ends with
a skippable frame that holds the seek table (compressed and plain size of each frame). The index maps a
record's id to archive, frame and the record's place within the frame, so that one record is read by
decompressing one frame.

Each task writes archives of its own in the shared folder, named by partition and attempt; the index,
which Spark commits with the task, names those that count. So a lost executor or a second attempt leaves
at most unused files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import arrow_map, binary_of, settle, shared_dir, spread

FRAME_BYTES = 256 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES = 128 << 20  # uncompressed, of a task that reads back
LEVEL = 3
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:citeloom:page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class SeekableWriter:
    """Records into frames; write() tells the frame and the place in it."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES) -> None:
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.open: list[bytes] = []
        self.held = self.size = 0
        self.table: list[tuple[int, int]] = []

    def write(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.table), self.held
        self.open.append(record)
        self.held += len(record)
        return at

    def flush(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.stream.write(frame)
            self.table.append((len(frame), self.held))
            self.size += len(frame)
            self.open, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.stream.close()


class SeekableReader:
    """Frames of an archive by number, through the seek table at its end; the last one read is kept."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.opener = file, zstandard.ZstdDecompressor()
        end = file.size()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEKABLE:
            raise ValueError("the archive has no seek table")
        width = 12 if flags & 0x80 else 8
        file.seek(end - 9 - n * width)
        raw = file.read(n * width)
        sizes = [struct.unpack_from("<II", raw, i * width) for i in range(n)]
        self.starts, self.sizes, at = [], sizes, 0
        for packed, _ in sizes:
            self.starts.append(at)
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.file.seek(self.starts[k])
            self.last = k, self.opener.decompressobj().decompress(self.file.read(self.sizes[k][0]))
        return self.last[1]


def record(page_id, url: str | None, payload: bytes, refers_to, date: str, page_digest: str) -> bytes:
    """A response record with the payload, or a revisit record without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{page_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and the payload's stated length of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, said


def _open_fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id and to: list of (digest, refers_to) of the pages whose payload a page of larger id has too."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for b in batches:
            payloads = binary_of(b["html"])
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha1(x).digest() for x in payloads], pa.binary())], names=["page_id", "size", "digest"])

    seen = settle(arrow_map(spread(pages.select("page_id", "html")).where("page_id is not null"), run, f"page_id {kind}, size long, digest binary").where(F.col("size") >= min_bytes), "digests")
    shared = settle(seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least <> refers_to").select("digest", "refers_to"), "shared")
    return settle(seen.join(shared, "digest").where("page_id <> refers_to").groupBy("page_id").agg(F.collect_set(F.struct("digest", "refers_to")).alias("to")), "revisits")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder, a URI that all executors reach; return the
    index: page_id, archive, frame, at, length.

    A null html is an empty payload. Of pages with equal payloads of min_bytes or more, that of the largest
    id is the response; the others refer to it. Rows of that id are all responses, and so are rows without an
    id. Other columns are ignored.
    """
    kind = dict(pages.dtypes)["page_id"]
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = revisits(pages, min_bytes)
    joined = spread(pages.select("page_id", "url", "html")).join(again.withColumnRenamed("page_id", "__id"), F.col("page_id") == F.col("__id"), "left").drop("__id")

    def run(batches):
        task = TaskContext.get()
        system, path = _open_fs(folder)
        system.create_dir(path, recursive=True)
        writer, name, part = None, "", 0
        for b in batches:
            rows: list[tuple] = []
            for page_id, url, payload, to in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), binary_of(b["html"]), b["to"].to_pylist(), strict=True):
                sha = hashlib.sha1(payload).digest()
                refers = next((x["refers_to"] for x in to or () if x["digest"] == sha), None)
                if writer is None:
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{part:03d}.warc.zst"
                    writer, part = SeekableWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes), part + 1
                raw = record(page_id, url, payload, refers, date, base64.b32encode(sha).decode())
                frame, at = writer.write(raw)
                rows.append((page_id, name, frame, at, len(raw)))
                if writer.size > ARCHIVE_BYTES:
                    writer.close()
                    writer = None
            kinds = [b.schema.field("page_id").type, pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "archive", "frame", "at", "length"])
        if writer is not None:
            writer.close()

    return settle(arrow_map(joined, run, f"page_id {kind}, archive string, frame int, at long, length long"), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Digests of responses are computed anew from what was read and must equal those stated.
    """
    kind = dict(index.dtypes)["page_id"]

    def run(batches):
        system, path = _open_fs(folder)
        archive, reader = None, None
        for b in batches:
            rows = []
            for name, frame, at, length in zip(b["archive"].to_pylist(), b["frame"].to_pylist(), b["at"].to_pylist(), b["length"].to_pylist(), strict=True):
                if name != archive:
                    archive, reader = name, SeekableReader(system.open_input_file(f"{path}/{name}"))
                fields, payload, said = parse(reader.frame(frame)[at : at + length])
                stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (digest_of(payload) != stated or len(payload) != said):
                    raise ValueError(f"a record of {name} differs from its digest")
                to = fields.get("WARC-Refers-To")
                rows.append((fields.get("WARC-Target-URI"), fields["WARC-Type"], to and to.strip("<>").removeprefix(_ID), said, stated, payload))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b["page_id"], *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    # the index is tiny beside what it names, so the tasks are counted from the bytes to read
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    dealt = index.repartitionByRange(tasks, "archive", "frame").sortWithinPartitions("archive", "frame", "at")
    out = arrow_map(dealt, run, f"page_id {kind}, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out.withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read them back, and tell of each record what was read."""
    folder = f"{shared_dir(pages.sparkSession)}/citeloom-warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder, min_bytes)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

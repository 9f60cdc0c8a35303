"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME bytes. A skippable frame at
the end of the file holds the seek table (compressed and plain size of each frame), so any
Zstandard tool reads the file whole and a reader with the table opens one frame. The index table
maps each record identifier to a file, a frame and an offset in the frame's plain bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch

FRAME = 1 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100

# Fixed values of the seekable Zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

#: What stands before every payload; pages keep no headers of their own.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Frames of the archives that a task reads back.
FRAMES_A_TASK = 8
EPOCH = "1970-01-01T00:00:00Z"


class BundleWriter:
    """Writes records into frames; memory holds one frame and the seek table."""

    def __init__(self, out, frame: int = FRAME, level: int = 3):
        self.out, self.frame, self.zstd = out, frame, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.size, self.table, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Returns the record's frame number and its offset in the frame's plain bytes."""
        if self.size and self.size + len(record) > self.frame:
            self._flush()
        at = len(self.table), self.size
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        self.table.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> int:
        if self.size:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        foot = struct.pack("<II", SKIPPABLE, len(body)) + body
        self.out.write(foot)
        return self.written + len(foot)


class BundleReader:
    """Opens frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        frames, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or flags & 0x7F:
            raise ValueError("not a seekable bundle")
        entry = 12 if flags & 0x80 else 8
        table = file.read_at(frames * entry, size - 9 - frames * entry)
        self.sizes = [struct.unpack_from("<II", table, k * entry) for k in range(frames)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        data = self.zstd.decompressobj().decompress(self.file.read_at(self.sizes[k][0], self.starts[k]))
        if len(data) != self.sizes[k][1]:
            raise ValueError("a frame is not as long as the seek table says")
        return data


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 HTTP response of one page; a revisit carries no payload, only its size and digest."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = HTTP_HEAD if revisit else HTTP_HEAD + payload
    return ("\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at an offset; the payload's digest and length must agree."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in rest)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    body = block[block.index(b"\r\n\r\n") + 4 :]
    if head["WARC-Type"] == "response" and (len(body) != int(head["X-Payload-Length"]) or hashlib.sha256(body).hexdigest() != head["WARC-Payload-Digest"].removeprefix("sha256:")):
        raise ValueError("a payload is not what its header says")
    return head, body


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses).

    Of records with equal payloads of at least LEAST_REVISIT bytes the one with the smallest
    page_id is the response. Only digests and ids are gathered; only digests that repeat are
    joined back. Rows that repeat the smallest page_id, and rows without page_id, stay responses.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"))
    firsts = base.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.write(firsts.where("n > 1").select("digest", "first"), "firsts")
    return base.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, name: str = "warc") -> DataFrame:
    """Write every page as a record; returns the index: record_id, path, frame, offset.

    File names carry the task attempt; only files that the index names count. Null html is an
    empty payload, null url an empty target; repeated rows are a record each, a null page_id has an
    empty identifier; other columns are left out; an empty table writes no file.
    """
    root = scratch.path(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                if writer is None:
                    store, at = fs.FileSystem.from_uri(root)
                    store.create_dir(at, recursive=True)
                    file = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{at}/{file}", compression=None)
                    writer = BundleWriter(out)
                rows = []
                for row in part.to_pylist():
                    record = make_record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                    rows.append((record_id(row["page_id"]), f"{root}/{file}", *writer.add(record)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["record_id", "path", "frame", "offset"])
        if writer is not None:
            writer.close()
            out.close()

    return scratch.write(with_revisits(pages, scratch).mapInArrow(run, "record_id string, path string, frame int, offset long"), f"{name}-index")


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the indexed records back: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, held = None, None, (-1, b"")
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                rows = []
                for row in batch.slice(k, 128).to_pylist():
                    if row["path"] != path:
                        if file is not None:
                            file.close()
                        path, held = row["path"], (-1, b"")
                        store, at = fs.FileSystem.from_uri(path)
                        file = store.open_input_file(at)
                        reader = BundleReader(file)
                    if held[0] != row["frame"]:
                        held = row["frame"], reader.frame(row["frame"])
                    head, body = parse_record(held[1], row["offset"])
                    if head["WARC-Record-ID"] != row["record_id"]:
                        raise ValueError("the index names another record")
                    other = head.get("WARC-Refers-To")
                    rows.append((page_of(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], page_of(other) if other else None, *([body] if with_payload else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    tasks = -(-index.select("path", "frame").distinct().count() // FRAMES_A_TASK)
    ordered = index.repartitionByRange(max(1, tasks), "path", "frame").sortWithinPartitions("path", "frame", "offset")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)

"""Token ids on disk: patched frame-of-reference blocks in shard files.

A shard file holds, in ascending doc_id order, the ids of its documents, each ended by id 0:

    "TIDEPFOR" | block ... | document table | block table | footer

    block           u32 minimum, u16 ids less 1, u8 width, u16 exceptions | packed low bits |
                    u16 positions, u32 values of the exceptions
    document table  i64 doc_id and u32 count a document; u8 1 where doc_id is null
    block table     u64 where each block starts
    footer          u64 document table, u64 block table, u64 documents, u64 ids, u32 crc32 of both tables

Numbers are little-endian. A block holds BLOCK ids (the last may hold fewer): the block minimum is
subtracted, the width is that of the PERCENTILE-th value, and values that need more bits stand in
the exception list. Shard files carry the task attempt in their names; only those that the
manifest table names count, so retried and speculative tasks do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch
from tidebook.llm.tokens import encoder, portions

MAGIC = b"TIDEPFOR"
BLOCK = 4096
PERCENTILE = 96
HEAD = struct.Struct("<IHBH")
FOOT = struct.Struct("<QQQQI")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Encode 1 to 65536 unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    low = int(ids.min())
    rest = ids - np.uint32(low)
    width = int(np.partition(rest, k := (len(rest) - 1) * int(percentile) // 100)[k]).bit_length()
    out = np.nonzero(rest >> np.uint32(width) if width < 32 else np.zeros(0))[0]
    if len(out) > 65535:
        width, out = 32, out[:0]
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=None)[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return HEAD.pack(low, len(ids) - 1, width, len(out)) + packed + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, less, width, n_out = HEAD.unpack_from(data, at)
    n, at = less + 1, at + HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * width).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    rest = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    where = np.frombuffer(data, "<u2", n_out, at)
    rest[where] = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    return rest + np.uint32(low)


class ShardWriter:
    """Writes one shard file; memory holds a block of ids and 13 bytes a document."""

    def __init__(self, out, block: int = BLOCK):
        if not 0 < block <= 65536:
            raise ValueError("a block holds 1 to 65536 ids")
        self.out, self.block, self.at, self.n_ids = out, block, 0, 0
        self.docs, self.counts, self.nulls, self.starts, self.held, self.held_n = [], [], [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.held_n += len(ids) // 4
        if self.held_n >= self.block:
            self._blocks(False)

    def _blocks(self, all_of: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if all_of else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            self.starts.append(self.at)
            self._put(pack_block(ids[k : min(k + self.block, end)]))
        self.held, self.held_n = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> int:
        """Write the tables; returns the file's bytes."""
        self._blocks(True)
        tables = np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.nulls, "u1").tobytes()
        docs_at, blocks_at = self.at, self.at + len(tables)
        tables += np.array(self.starts, "<u8").tobytes()
        self._put(tables + FOOT.pack(docs_at, blocks_at, len(self.docs), self.n_ids, zlib.crc32(tables)))
        return self.at


class ShardReader:
    """Reads a shard file by ranges: its tables at once, its ids block by block."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.docs_at, self.blocks_at, n, self.n_ids, crc = FOOT.unpack(file.read_at(FOOT.size, size - FOOT.size))
        tables = file.read_at(size - FOOT.size - self.docs_at, self.docs_at)
        if file.read_at(len(MAGIC), 0) != MAGIC or zlib.crc32(tables) != crc:
            raise ValueError("not a whole shard file")
        self.docs = np.frombuffer(tables, "<i8", n)
        self.counts = np.frombuffer(tables, "<u4", n, 8 * n)
        self.nulls = np.frombuffer(tables, "u1", n, 12 * n)
        self.starts = np.frombuffer(tables, "<u8", (len(tables) - 13 * n) // 8, 13 * n).tolist() + [self.docs_at]

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self.file.read_at(self.starts[k + 1] - self.starts[k], self.starts[k]))

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, place of its first id in the shard, ids) in file order."""
        k, held, at = 0, b"", 0
        for doc, count, null in zip(self.docs.tolist(), self.counts.tolist(), self.nulls.tolist()):
            parts, have = [held], len(held)
            while have < 4 * count:
                parts.append(self.block(k).tobytes())
                have += len(parts[-1])
                k += 1
            data = b"".join(parts)
            yield None if null else doc, at, data[: 4 * count]
            held, at = data[4 * count :], at + count


def write_shards(docs: DataFrame, scratch: Scratch, name: str = "shards", vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts and write shard files in ascending doc_id order (null first; equal ids by text hash).

    Returns the manifest: shard, path, documents, ids, bytes and first_id (ids in all shards before).
    Null text counts as empty. An empty table gives an empty manifest.
    """
    root = scratch.path(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        store, at = fs.FileSystem.from_uri(root)
        path, writer = f"{at}/{shard:08d}-{uuid.uuid4().hex}.pfor", None
        for batch in batches:
            for part in portions(batch):
                if writer is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    writer = ShardWriter(out)
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist())):
                    writer.add(doc, ids)
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path.rsplit("/", 1)[1]], "documents": [len(writer.docs)], "ids": [writer.n_ids], "bytes": [size]})

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = scratch.write(dealt.mapInArrow(run, "shard long, path string, documents long, ids long, bytes long"), f"{name}-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard file
    return found.select("shard", F.concat(F.lit(root + "/"), "path").alias("path"), "documents", "ids", "bytes", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first_id"))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read shard files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(at) as file:
                    rows = []
                    for doc, k, ids in ShardReader(file).documents():
                        rows.append((doc, row["first_id"] + k, len(ids) // 4, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").astype("i8")] if with_ids else [])))
                        if len(rows) == 1024:
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    shards = max(1, manifest.count())
    one_each = manifest.select("shard", "path", "first_id").repartitionByRange(shards, "shard")
    return one_each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)

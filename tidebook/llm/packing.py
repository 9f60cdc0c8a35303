"""Best-fit packing of token pieces into sequences of a fixed length.

Bounded-space online best fit: a fixed number of open sequences stand in a bitset keyed by free
space. A piece goes to the open sequence whose free space fits it most closely; where none fits, a
new one opens, and if too many are open the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch
from tidebook.llm.tokens import encoding, portions

CAPACITY = 2048
#: Open sequences a packing task keeps.
OPEN = 4096
#: Pieces a packing task gets; a task holds OPEN small integers whatever their number.
PIECES_A_TASK = 1_000_000
#: Pieces that are packed longest first.
WINDOW = 10_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class OpenSequences:
    """Open sequences by free space; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int, most: int):
        if capacity < 1 or most < 1:
            raise ValueError("capacity and most must be positive")
        self.capacity, self.most, self.bits, self.by_free, self.open, self.made = capacity, most, 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} ids does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open == self.most and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, sequence = self.capacity, self.made
            self.made += 1
        if free > length:
            self.by_free.setdefault(free - length, []).append(sequence)
            self.bits |= 1 << (free - length)
            self.open += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        sequence = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return sequence


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Tokenize whole texts and cut documents longer than ``capacity``; only the first piece may be shorter.

    Null text counts as empty (one end id); null doc_id stays null; every input row gives its own pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(vocabulary) as encode:
            for batch in batches:
                for part in portions(batch):
                    rows = []
                    for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist())):
                        n, start, k = len(ids) // 4, 0, 0
                        while start < n:
                            length = (n - start) % capacity or capacity
                            rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                            start, k = start + length, k + 1
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, WINDOW in each batch but the last, whatever the batches were."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(x.num_rows for x in held) >= WINDOW:
            whole = pa.concat_batches(held)
            yield whole.slice(0, WINDOW)
            held = [whole.slice(WINDOW)]
    if held and (whole := pa.concat_batches(held)).num_rows:
        yield whole


def pack(found: DataFrame, tasks: int, capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """Give every piece a sequence and an offset; each of ``tasks`` tasks packs its own share.

    Needs columns of ``pieces``. Pieces are dealt by a hash of doc_id, piece and content, in whose
    order they are packed, WINDOW at a time and the longest of those first: the same pieces and
    ``tasks`` pack alike however they come. Only rows equal in all three share a task for certain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenSequences(capacity, most), TaskContext.get().partitionId() << 40
        for batch in windows(batches):
            lengths = batch["length"].to_numpy()
            got = [(0, 0)] * len(lengths)
            for i in np.argsort(-lengths, kind="stable").tolist():  # longest of the batch first: short ones fill what is left
                got[i] = bins.place(int(lengths[i]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())],
                names=[*NAMES, "sequence_id", "offset"])

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = found.select(*NAMES).repartition(tasks, mixed).sortWithinPartitions(mixed, "doc_id", "piece", "start", "length")
    return dealt.mapInArrow(run, PLACED)


def pack_documents(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY, most: int = OPEN,
                   pieces_a_task: int = PIECES_A_TASK, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` ids as this method can.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An
    empty table gives none. Extra columns are left out.
    """
    found = scratch.write(pieces(docs, capacity, vocabulary), "pieces")
    tasks = max(2, -(-found.count() // pieces_a_task))
    return pack(found, tasks, capacity, most)

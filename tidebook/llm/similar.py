"""Near-duplicate documents of a given shingle similarity, by SimHash and multi-index hashing.

For a similarity as low as 0.8 a 64-bit fingerprint and a fixed radius do not do: such texts differ
in about 15 % of the bits. Here a text's distinct shingles give as many segments of bits as it takes
to lose no more than MISS of the pairs at the similarity (``tables_for``), and in each segment the
Hamming ball is enumerated over the bits whose votes were closest to a tie, which are those that a
small edit turns. Both sides enumerate, so two texts meet in a table if they differ in at most two
such bits. Texts that meet and whose first 256 bits differ in no more than DEVIATIONS standard
deviations above what the similarity gives are candidates, however many share the entry, and the
similarity of every candidate pair is verified on whole shingle sets.

In an entry that more than CROWD texts share, each is checked against the smallest; texts that are
then still in different groups are compared block by block on their shingle sets, and only links
that join parts not joined before leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import tables
from tidebook.llm.common import Scratch, components, free_names
from tidebook.llm.embeddings import Joined

SHINGLE = 5
SIMILARITY = 0.8
MISS = 0.0005
LEAST_BITS = 24
#: Share of pairs of segments differing in 0, 1 or 2 bits in which those bits are among the closest, so that the segments meet.
TURNED = (1.0, 0.95, 0.87)
#: Words of 64 bits of the fingerprint that entries carry, and by how many standard deviations copies' distances may exceed the mean.
PRINT, DEVIATIONS = ("p0", "p1", "p2", "p3"), 3.5
CROWD = 16
BLOCK, BLOCK_BYTES = 256, 16 << 20
COLUMNS = ", ".join(f"{c} long" for c in PRINT)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of word shingles, ascending; fewer words than ``size`` are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts, hashed = [0, *(e + 1 for e in ends[:-1])], xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b]) for a, b in zip(starts, ends[size - 1 :])] or [hashed(joined)], np.uint64))


def votes(found: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 * words fingerprint bits, how far the hashes with that bit outnumber those without."""
    out = np.zeros((words, 64), np.int64)
    for k in range(words):
        step = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for at in range(0, len(found), 8192):
            h = found[at : at + 8192] + step
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[k] += bits.sum(axis=0, dtype=np.int64)
    return 2 * out.ravel() - len(found)


def table_keys(margins: np.ndarray, segments: int, bits: int, flips: int) -> np.ndarray:
    """The text's entries, a LONG each: segment number, then the segment's bits, whole and with one close bit turned."""
    parts = margins[: segments * bits].reshape(segments, bits)
    values = (parts > 0) @ (1 << np.arange(bits)) + (np.arange(segments) << bits)
    close = np.argsort(np.abs(parts), axis=1, kind="stable")[:, :flips]
    return np.concatenate([values, (values[:, None] ^ (1 << close)).ravel()])


def rate(similarity: float) -> float:
    """Share of bits in which texts of that similarity and about equal size differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(texts: int, similarity: float) -> tuple[int, int, int]:
    """Segments, bits of each and bits turned, so that an entry holds few texts by chance and MISS is the share of pairs lost at the similarity.

    Bits of two such texts differ at the rate that the angle between their sets has; within a
    segment up to two bits may differ, if each is among the closest of one side (TURNED, measured).
    """
    bits, differ = max(LEAST_BITS, math.ceil(math.log2(max(texts, 1)))), rate(similarity)
    meet = sum(math.comb(bits, d) * differ**d * (1 - differ) ** (bits - d) * TURNED[d] for d in range(3))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - meet))), bits, bits // 4


def prints(docs: DataFrame, size: int, shape: tuple[int, int, int]) -> DataFrame:
    """doc_id, text_hash, cid (of the set of shingles), and the set's fingerprint (PRINT) and table keys (bytes)."""
    words = max(len(PRINT), -(-shape[0] * shape[1] // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part["text"].to_pylist():
                    found = shingles(text, size)
                    margins = votes(found, words)
                    own = np.packbits(margins[: 64 * len(PRINT)] > 0, bitorder="little").view("<i8").tolist()
                    rows.append((xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), *own, table_keys(margins, *shape).astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], *[pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), *[pa.int64()] * len(PRINT), pa.binary()))]],
                                                 names=["doc_id", "text_hash", "cid", *PRINT, "keys"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(run, f"doc_id long, text_hash long, cid long, {COLUMNS}, keys binary")


def entries(distinct: DataFrame) -> DataFrame:
    """key, cid and PRINT of each text in each of its table entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = np.frombuffer(b"".join(part["keys"].to_pylist()), "<i8")
                n = len(keys) // max(1, part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.repeat(part[c].to_numpy(), n)) for c in ("cid", *PRINT)]], names=["key", "cid", *PRINT])

    return distinct.select("cid", *PRINT, "keys").mapInArrow(run, f"key long, cid long, {COLUMNS}")


def near_prints(similarity: float) -> Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]:
    """Says of fingerprints (PRINT) whether they are as near as those of texts of the similarity."""
    bits, differ = 64 * len(PRINT), rate(similarity)
    most = bits * differ + DEVIATIONS * math.sqrt(bits * differ * (1 - differ))

    def near(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        return sum(np.bitwise_count((u ^ v).view(np.uint64)).astype(np.int32) for u, v in zip(x, y)) <= most

    return near


def crowded_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the texts of different components of each crowded entry, enough to join what they join.

    ``members`` has key, cid, root, PRINT and set (bytes).
    """

    near = near_prints(similarity)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cid", ignore_index=True)
        sets = [np.frombuffer(x, "<u8") for x in part["set"]]
        sizes, ids, root = np.array([len(x) for x in sets]), part["cid"].tolist(), part["root"].to_numpy()
        _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        who, col = np.repeat(np.arange(len(sets)), sizes)[often[col] > 1], col[often[col] > 1]  # a shingle of one text alone is shared by none
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            inside = slice(*np.searchsorted(col, [at, at + 4096]))
            there = np.zeros((len(sets), 4096), np.float32)
            there[who[inside], col[inside] - at] = 1
            shared += there @ there.T
        i, j = np.nonzero(np.triu(shared >= similarity * (sizes[:, None] + sizes[None, :] - shared), 1) & (root[:, None] != root[None, :]))
        own, joined = [part[c].to_numpy() for c in PRINT], Joined()
        fine = near([x[i] for x in own], [x[j] for x in own])
        out = [(ids[a], ids[b]) for a, b in zip(i[fine].tolist(), j[fine].tolist()) if joined.join(ids[a], ids[b])]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = tables.in_blocks(members, F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES)))
    return dealt.select("key", "x", "y", "cid", "root", *PRINT, "set").groupBy("key", "x", "y").applyInPandas(run, "a long, b long")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """cid and set (sorted 64-bit shingle hashes as bytes) of texts that have a cid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part["cid"], pa.array([shingles(t, size).tobytes() for t in part["text"].to_pylist()], pa.binary())], names=["cid", "set"])

    return docs.select("cid", "text").mapInArrow(run, "cid long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and root (equal within a group of near duplicates) of every row.

    Texts whose distinct word shingles are equal, and texts whose Jaccard similarity over them is
    at least ``similarity``, are in one group, and so is what such links join. Null, empty and
    wordless texts have no shingles and form one group. Extra columns are left out; an empty table
    gives no rows.
    """
    found = scratch.write(prints(docs, size, tables_for(docs.count(), similarity)), "prints")
    distinct = scratch.write(found.groupBy("cid").agg(F.min_by(F.struct(*PRINT, "keys"), F.struct("doc_id", "text_hash")).alias("p"),
                                                      F.min(F.struct("doc_id", "text_hash")).alias("f")).select("cid", "p.*", F.col("f.doc_id").alias("doc_id"), F.col("f.text_hash").alias("text_hash")), "distinct")
    met = scratch.write(tables.meet(entries(distinct), entries(distinct.sample(False, tables.SAMPLE, 1)), list(PRINT), near_prints(similarity), CROWD), "meet")
    pairs = scratch.write(met.where("b is not null").select("a", "b").distinct(), "pairs")
    crowd = met.where("key is not null").select("key", F.col("a").alias("cid"), *PRINT)
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(crowd.select("cid")).distinct()
    needed = scratch.write(needed.join(distinct.select("cid", "doc_id", "text_hash"), "cid"), "needed")
    texts = keyed.join(needed.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    sets = scratch.write(sets_of(texts, size).dropDuplicates(["cid"]), "sets")
    crowded = not crowd.isEmpty()
    if crowded:  # most of a large group of copies is joined by its stars, and pairs within it need no check
        star = scratch.write(verified(tables.stars(crowd), sets, similarity), "stars")
        own = components(star, scratch, "cc-stars")
        for side in ("a", "b"):
            pairs = pairs.join(own.select(F.col("node").alias(f"node_{side}"), F.col("root").alias(f"root_{side}")), F.col(side) == F.col(f"node_{side}"), "left")
        pairs = pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    edges = verified(pairs, sets, similarity)
    edges = scratch.write(edges.union(star) if crowded else edges, "edges")
    roots = components(edges, scratch)
    if crowded:
        members = scratch.write(tables.apart(crowd, roots), "apart")
        more = scratch.write(crowded_links(members.join(sets, "cid"), similarity), "more")
        if not more.isEmpty():
            roots = components(edges.union(more), scratch, "cc-more")
    roots = scratch.write(distinct.select("cid").join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("root")), "roots")
    for name in ("meet", "pairs", "needed", "sets", "edges"):
        scratch.drop(name)
    return found.select("doc_id", "text_hash", "cid").join(roots, "cid").select("doc_id", "text_hash", "root")


def keep_one(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest doc_id, null last.

    Null, empty and wordless texts are one group. Of rows equal in doc_id and text any one is kept.
    All columns are returned as they were, whatever their names; an empty table gives no rows.
    """
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = groups(docs, scratch, size, similarity).groupBy("root").agg(F.min(least).alias("k"))
    names = free_names(docs, "key", "null", "hash", "number")
    key, null, text, number = names
    own = lambda doc_id: (F.coalesce(doc_id.cast("long"), F.lit(0)).alias(key), doc_id.isNull().alias(null))
    kept = scratch.write(kept.select(*own(F.col("k.doc_id")), F.col("k.text_hash").alias(text)), "kept")
    keyed = docs.select("*", *own(F.col("doc_id")), F.xxhash64("text").alias(text))
    once = F.row_number().over(Window.partitionBy(*names[:3]).orderBy(F.lit(1)))  # dealt as the join is
    return keyed.join(kept.hint("merge"), names[:3]).withColumn(number, once).where(F.col(number) == 1).select(*docs.columns)

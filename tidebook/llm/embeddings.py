"""Near-duplicate vectors by sorted projection passes.

Each pass gives every distinct vector the concatenation of random hyperplane bits, sorts by
(label, bits) over the whole table and compares each vector with the WINDOW before it; passes use
other hyperplanes, and the verified pairs of all passes are united into components. A pass emits
only the links that join parts of its window not joined before, so a dense group costs no more
than a sparse one. Inside each component all pairs are then verified in blocks, which counts every
link there exactly, also those that no window saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, components

COSINE = 0.98
PASSES = 12
BITS = 60
WINDOW = 24
#: Rows of a pass that one task compares: far more than WINDOW, so that a window ends in the next task at the latest.
ROWS_A_TASK = 16_384
#: Vectors of a component that one block of the exact count holds.
BLOCK = 1024


def codes(vectors: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """One LONG a vector: BITS signs of random projections, the first the most significant."""
    planes = np.random.default_rng([seed, turn, vectors.shape[1]]).standard_normal((vectors.shape[1], BITS))
    return ((vectors @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def raw(vector: list) -> bytes:
    """The bytes of a vector: as float32 if that loses nothing, else as float64 with one byte more."""
    own = np.array(vector, "<f8")
    with np.errstate(over="ignore"):
        short = own.astype("<f4")
    return short.tobytes() if (short == own).all() else own.tobytes() + b"d"


def vector_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:-1], "<f8") if len(data) % 4 else np.frombuffer(data, "<f4")


def unit(vectors: list[bytes]) -> np.ndarray:
    got = np.stack([vector_of(v) for v in vectors]).astype(float)
    got /= np.abs(got).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return got / np.linalg.norm(got, axis=1, keepdims=True)


def window_links(rows: np.ndarray, fresh: int, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) with j >= fresh, i < j <= i + window and cosine at least ``least``."""
    for d in range(1, min(window, len(rows) - 1) + 1):
        lo = max(fresh - d, 0)
        close = np.einsum("ij,ij->i", rows[lo : len(rows) - d], rows[lo + d :]) >= least
        for i in np.nonzero(close)[0].tolist():
            yield lo + i, lo + i + d


class Joined:
    """Union-find over the vectors of one task: says whether a link joins two parts."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """label, h1, h2, embedding, n (copies) and first (smallest vec_id) of the vectors that can link."""
    usable = F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(usable).groupBy("label", "h1", "h2", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def pass_rows(distinct: DataFrame, passes: int, seed: int) -> DataFrame:
    """One row a vector and pass: turn, label, size, code, cid, vector (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"].to_pylist()
            found, sizes = [raw(v) for v in lists], np.array([len(v) for v in lists])
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                vectors, own = unit([found[i] for i in at]), batch.take(pa.array(at))
                whole = pa.array([found[i] for i in at], pa.binary())
                for turn in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), turn)), own["label"].cast(pa.int64()), pa.array(np.full(len(at), size, np.int64)), pa.array(codes(vectors, turn, seed)), own["cid"], whole],
                        names=["turn", "label", "size", "code", "cid", "vector"])

    return distinct.select("cid", "label", "embedding").mapInArrow(run, "turn long, label long, size long, code long, cid long, vector binary")


def link_windows(rows: DataFrame, scratch: Scratch, window: int, least: float, tasks: int) -> DataFrame:
    """Links (a, b) that the passes' windows show; enough of them to join what they join."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, joined, kept, seen, tail = TaskContext.get().partitionId(), Joined(), None, 0, []
        for batch in batches:
            keys = list(zip(batch["turn"].to_pylist(), batch["label"].to_pylist(), batch["size"].to_pylist()))
            ids, whole, start, out = batch["cid"].to_pylist(), batch["vector"].to_pylist(), 0, []
            head = [(part - 1, 1, seen + i, *keys[i], ids[i], whole[i]) for i in range(min(len(ids), max(0, window - seen)))]
            seen += len(ids)
            tail = (tail + [(part, 0, 0, *k, i, v) for k, i, v in list(zip(keys, ids, whole))[-window:]])[-window:]
            while start < len(ids):
                end = start + 1
                while end < len(ids) and keys[end] == keys[start] and end - start < 4096:
                    end += 1
                if kept is None or kept[0] != keys[start]:
                    if kept is not None and kept[0][0] != keys[start][0]:
                        joined = Joined()  # links of another pass are worth their own rows
                    kept = keys[start], [], np.zeros((0, keys[start][2]))
                own, all_ids = unit(whole[start:end]), kept[1] + ids[start:end]
                both = np.concatenate([kept[2], own])
                out += [(all_ids[i], all_ids[j]) for i, j in window_links(both, len(kept[1]), window, least) if joined.join(all_ids[i], all_ids[j])]
                kept = keys[start], all_ids[-window:], both[-window:]
                start = end
            yield table([(a, b, None, None, None, None, None, None, None) for a, b in out] + [(h[6], None, h[0], h[1], h[2], *h[3:6], h[7]) for h in head])
        yield table([(t[6], None, t[0], t[1], i, *t[3:6], t[7]) for i, t in enumerate(tail)])

    names = ["a", "b", "seam", "after", "place", "turn", "label", "size", "vector"]
    types = [pa.int64()] * 8 + [pa.binary()]

    def table(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got) if got else [[]] * len(names), types)], names=names)

    def across(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["after", "place"])
        ids, out, joined = part["a"].tolist(), [], Joined()
        key, after = list(zip(part["turn"], part["label"], part["size"])), part["after"].tolist()
        runs: dict[tuple, list[int]] = {}
        for i, k in enumerate(key):
            runs.setdefault(k, []).append(i)
        for at in runs.values():
            rows = unit([part["vector"].iloc[i] for i in at])
            out += [(ids[at[i]], ids[at[j]]) for i, j in window_links(rows, 1, window, least) if after[at[i]] != after[at[j]] and joined.join(ids[at[i]], ids[at[j]])]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    order = ["turn", "label", "size", "code", "cid"]
    found = scratch.write(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        inside, "a long, b long, seam long, after long, place long, turn long, label long, size long, vector binary"), "windows")
    seams = found.where("b is null").groupBy("seam").applyInPandas(across, "a long, b long")  # two windows a seam
    return found.where("b is not null").select("a", "b").union(seams)


def count_links(members: DataFrame, least: float, block: int) -> DataFrame:
    """cid and links (copies of other vectors at least that close) within each component.

    ``members`` has root, cid, n and vector. A component is cut into blocks, and each pair of
    blocks is one group, so a task never holds more than two blocks.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = part["own"].to_numpy()
        left, right = (part[own == key[1]], part[own == key[2]])
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": []}, dtype="int64")
        close = unit(left["vector"].tolist()) @ unit(right["vector"].tolist()).T >= least
        if key[1] == key[2]:
            np.fill_diagonal(close, False)
            return pd.DataFrame({"cid": left["cid"], "links": close @ right["n"].to_numpy()})
        return pd.DataFrame({"cid": [*left["cid"], *right["cid"]], "links": [*(close @ right["n"].to_numpy()), *(close.T @ left["n"].to_numpy())]})

    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "n", "vector")
    return dealt.groupBy("root", "low", "high").applyInPandas(run, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, scratch: Scratch, least: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, seed: int = 8) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Rows link when their labels are equal and not null and their cosine in double precision is at
    least ``least``. Rows whose embedding is null, empty, zero, or holds a null or non-finite
    component link with nothing, nor do vectors of different length. Equal vectors count as
    copies of one another. Repeated vec_ids give a row each; a null vec_id is never a
    component_id unless alone (then null, and kept is false). An empty table gives no rows; other
    columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"),
                          F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    distinct = scratch.write(distinct_vectors(rows).withColumn("cid", F.monotonically_increasing_id()), "distinct")
    tasks = max(1, -(-distinct.count() * passes // ROWS_A_TASK))
    links = scratch.write(link_windows(pass_rows(distinct, passes, seed), scratch, window, least, tasks), "links")
    roots = scratch.write(components(links, scratch).select(F.col("node").alias("cid"), "root"), "roots")
    sizes = scratch.write(roots.groupBy("root").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")), "sizes")
    blocked = roots.join(sizes, "root")
    members = scratch.write(distinct.join(blocked, "cid").select("root", "blocks", "cid", "n", "first", "embedding"), "members")
    counted = count_links(members.mapInArrow(as_bytes, "root long, blocks long, cid long, n long, vector binary"), least, block)
    least_id = members.groupBy("root").agg(F.min("first").alias("component_id"))
    found = scratch.write(members.select("cid", "root").join(scratch.write(least_id, "least"), "root").join(scratch.write(counted, "counted"), "cid"), "found")
    by_vector = scratch.write(distinct.join(found, "cid", "left").select(
        "label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "by-vector")
    out = rows.select("vec_id", "label", "h1", "h2").join(by_vector, ["label", "h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = pa.array([raw(v) for v in batch["embedding"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["root"], batch["blocks"], batch["cid"], batch["n"], whole], names=["root", "blocks", "cid", "n", "vector"])

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

Two fingerprints within 2 bits differ in at most 1 bit in one of their two 32-bit segments. Each
segment therefore has a table from its value to fingerprints; a fingerprint looks up its own value
and the values one bit away (only the bits it has unset: of a pair that differs in a bit, exactly
one side has it unset), and full distances of what is found are verified. Where a segment value is
shared by more than CROWDED fingerprints, those fingerprints and all that look it up are linked
exactly by another way: each names the 65 words within one bit of itself, and fingerprints that
name the same word are within 2 bits of each other. At most 65 fingerprints can name one word, so
no group grows with the data. No table is broadcast: all of them grow with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, components, shuffled

SEED = 42
CROWDED = 32
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 where there are no words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashed = xxhash.xxh64_intdigest
    found = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])] or [hashed(joined, SEED)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 8192):
        part = np.array(found[k : k + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (LONG, the 64 bits) of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = np.array([fingerprint(t, shingle) for t in part["text"].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def links(distinct: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between different fingerprints of at most 2 differing bits, enough to connect all such pairs.

    ``distinct`` has each ``fingerprint`` once.
    """
    f = F.col("fingerprint")
    rows = distinct.select(f, F.explode(F.array(
        F.struct(F.lit(0).alias("segment"), f.bitwiseAND(F.lit(LOW)).alias("value")),
        F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned(f, 32).alias("value")))).alias("s")).select("fingerprint", "s.*")
    many = scratch.write(rows.groupBy("segment", "value").count().where(F.col("count") > crowded).select("segment", "value"), "crowded")
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << i for i in range(32))]])
    probes = rows.select("fingerprint", "segment", "value", F.explode(masks).alias("mask")).where(
        F.col("value").bitwiseAND(F.col("mask")) == 0)
    probes = probes.select(F.col("fingerprint").alias("a"), "segment", F.col("value").bitwiseOR(F.col("mask")).alias("value"), (F.col("mask") == 0).alias("same"))
    tables = rows.select(F.col("fingerprint").alias("b"), "segment", "value")
    if not many.isEmpty():
        # the values that look up a crowded one: itself, or it without one of its bits
        near = many.select("segment", "value", F.explode(masks).alias("mask")).where(F.col("value").bitwiseAND(F.col("mask")) == F.col("mask"))
        near = near.select("segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        held = scratch.write(rows.join(shuffled(near), ["segment", "value"], "left_semi").select(F.col("fingerprint").alias("a")).distinct(), "held")
        tables = tables.join(shuffled(many), ["segment", "value"], "left_anti")
    found = probes.join(shuffled(tables), ["segment", "value"]).where(
        (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    if many.isEmpty():
        return found
    bits = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    balls = held.select("a", F.explode(bits).alias("mask")).select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("word"))
    stars = balls.groupBy("word").agg(F.collect_list("a").alias("near")).where(F.size("near") > 1)  # at most 65
    return found.union(stars.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (LONG) and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most 2 differing bits. Null or
    wordless texts have fingerprint 0 and link like any other. Rows with a null doc_id belong to
    components too; a component of such rows alone has a null component_id. Repeated rows each
    give a row; an empty table gives none; other columns are left out.
    """
    found = scratch.write(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch.write(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    edges = scratch.write(links(distinct.select("fingerprint"), scratch), "edges")
    roots = components(edges, scratch, broadcast=False)
    rooted = distinct.join(shuffled(roots), distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_print = scratch.write(rooted.join(shuffled(least), "root").select("fingerprint", "component_id"), "by-print")
    return found.join(shuffled(by_print), "fingerprint").select("doc_id", "fingerprint", "component_id")

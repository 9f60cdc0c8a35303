"""Hash tables whose entries are compared: pairs that meet, and entries that very many share.

Rows (key, cid, payload) of one key are an entry. Small entries give pairs at once. An entry of over
``crowd`` rows gives none: its rows come out as they are, each is linked to the entry's smallest if
that holds (``stars``), and only entries that then still hold more than one component are compared,
in blocks (``apart``, ``in_blocks``). So a large group of copies costs as many checks as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with this share of the rows (of a sample, which has LEAST of them) does not go to one task; there are at most 1 / HOT of them.
HOT, LEAST, SAMPLE = 1e-3, 32, 1 / 64


def hot_keys(sample: DataFrame) -> list[int]:
    """Keys of more than about HOT of all rows, at most 1 / HOT of them; which are found changes no result, only who works."""
    counts = sample.groupBy("key").count()
    most = counts.orderBy(F.desc("count")).limit(int(1 / HOT)).where(F.col("count") >= LEAST).collect()
    if not most:
        return []
    total = counts.agg(F.sum("count")).first()[0]
    return [r["key"] for r in most if r["count"] >= HOT * total]


def meet(rows: DataFrame, sample: DataFrame, payload: list[str], close: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray], crowd: int) -> DataFrame:
    """(a, b, null ...) for pairs of different cids of an entry with ``close`` payloads, a < b, and (a, null, key, payload) for each row of a crowded entry.

    Pairs may repeat; ``payload`` names LONG columns; ``sample`` is the rows of about a share SAMPLE of the cids.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch[c].to_numpy() for c in ("key", "cid", *payload)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            if cut == 0 and len(held[0]) > crowd:
                known, cut = held[0][-1], len(held[0])  # crowded already: its rows need not wait for its end
            if cut:
                yield of([x[:cut] for x in held], known)
                held = [x[cut:] for x in held] if cut < len(held[0]) else None
        if held is not None:
            yield of(held, known)

    def of(own: list[np.ndarray], known: int | None) -> pa.RecordBatch:
        key = own[0]
        size = np.repeat(n := np.diff(np.append(np.nonzero(np.diff(key, prepend=key[0] - 1))[0], len(key))), n)
        if known is not None:
            size[key == known] = crowd + 1
        many = [x[size > crowd] for x in own]
        key, cid, *rest = [x[(size > 1) & (size <= crowd)] for x in own]
        out, d = [np.zeros((0, 2), np.int64)], 1
        while d < len(key) and (same := key[d:] == key[:-d]).any():
            i = np.nonzero(same & (cid[d:] != cid[:-d]))[0]
            i = i[close([x[i] for x in rest], [x[i + d] for x in rest])]
            out.append(np.stack([np.minimum(cid[i], cid[i + d]), np.maximum(cid[i], cid[i + d])], 1))
            d += 1
        got = np.unique(np.concatenate(out), axis=0)
        n, m = len(got), len(many[0])
        single = np.arange(n + m) >= n
        fill = lambda x: pa.array(np.concatenate([np.zeros(n, np.int64), x]), mask=~single)
        first, second = np.concatenate([got[:, 0], many[1]]), np.concatenate([got[:, 1], many[1]])
        return pa.RecordBatch.from_arrays([pa.array(first), pa.array(second, mask=single), fill(many[0]), *[fill(x) for x in many[2:]]], names=names)

    names = ["a", "b", "key", *payload]
    schema = ", ".join(f"{c} long" for c in names)
    hot = hot_keys(sample)
    some = rows.where(~F.col("key").isin(hot)) if hot else rows
    found = some.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(pairs, schema)
    if hot:
        found = found.union(rows.where(F.col("key").isin(hot)).select(F.col("cid").alias("a"), F.lit(None).cast("long").alias("b"), "key", *payload))
    return found


def stars(crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) of the smallest cid of each entry and every other one of it; ``crowd`` has key and cid."""
    least = crowd.groupBy("key").agg(F.min("cid").alias("a"))
    return crowd.join(least, "key").where("cid <> a").select("a", F.col("cid").alias("b")).distinct()


def apart(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows, with root, of entries that hold more than one component; ``roots`` has node and root (none: the node's own)."""
    own = crowd.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    several = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return own.join(several, "key")


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """``members`` dealt for comparing all of a key: a group (key, x, y) holds the blocks x and y, ``own`` says which a row is of.

    ``blocks`` is an aggregate that says how many blocks a key needs.
    """
    own = members.join(members.groupBy("key").agg(blocks.cast("long").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")

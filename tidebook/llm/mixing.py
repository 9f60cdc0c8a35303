"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of the words by weight, no more than ``most`` times what it has; the
excess goes to the others by weight. All documents of a source then have the same expected copies,
a whole number plus a fraction. Pivotal rounding makes the fractions whole: two documents exchange
words, one way or the other at random and without bias, until one fraction is 0 or 1; what is left
pairs with the next document. The words taken stay exactly at the target but for one document a
source. Buckets of documents are rounded apart, and what each leaves is combined up a tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, free_names, small_enough, word_count

BUCKET_ROWS = 8192
FANOUT = 256
BROADCAST_ROWS = 10_000
CLOSE = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, rows and target of each source; ``sizes`` has source and size.

    Weights repeat over sources in code point order, null last. The level L at which
    sum(min(weight * L, most * size)) is the wanted total is the largest over k of the level that
    results when the k sources with the smallest most * size / weight stand at their bound. The
    windows below order one row a source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    bound = F.col("source_size") * F.lit(float(most))
    before = Window.orderBy(bound / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    held, heavy = F.coalesce(F.sum(bound).over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    own = own.withColumn("level", (wanted - held) / (F.sum("weight").over(everything) - heavy))
    own = own.withColumn("target", F.least(F.col("weight") * F.max("level").over(everything), bound))
    return own.select("source", "source_size", "rows", "weight", "target")


def round_pivotally(sizes: np.ndarray, fraction: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Make fractions 0 or 1 keeping sum(sizes * fractions); returns them and the place of the one that is left, or -1."""
    p, left = fraction.astype(float).tolist(), -1
    dice = rng.random(len(p)).tolist()
    for j, b in enumerate(sizes.tolist()):
        if b == 0 or not CLOSE < p[j] < 1 - CLOSE:
            p[j] = float(p[j] >= 0.5)
            continue
        if left < 0:
            left = j
            continue
        a, i = sizes[left], left
        up, down = min(a * (1 - p[i]), b * p[j]), min(a * p[i], b * (1 - p[j]))
        move = up if dice[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / a, p[j] - move / b
        still = [k for k in (i, j) if CLOSE < p[k] < 1 - CLOSE]
        for k in (i, j):
            if k not in still:
                p[k] = float(p[k] >= 0.5)
        left = still[0] if still else -1
    return np.array(p), left


def rounder(seed: int, level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Rounds one bucket of a source; marks with whole = false the row that is left. The last level leaves none."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "no_id", "id", "text_hash", "size"], ignore_index=True)
        name = key[0] if isinstance(key[0], str) else None
        rng = np.random.default_rng(zlib.crc32(repr((seed, level, name, int(key[1]))).encode()))
        p, left = round_pivotally(part["size"].to_numpy(), part["p"].to_numpy(), rng)
        if left >= 0 and last:
            p[left], left = float(rng.random() < p[left]), -1
        return part.assign(p=p, whole=np.arange(len(part)) != left)

    return run


def mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns, for each row of ``docs``: doc_id, source, text_hash, size (words), source_size,
    target (both of its source) and copies. Null text has size 0 and no copies; null sources are
    one source, the last; rows with a null doc_id, which stays null, and repeated rows are rounded
    one by one; other columns are left out; an empty table gives no rows. Same rows and parameters
    give the same result however they are partitioned.
    """
    keys = ["id", "no_id", "source", "text_hash"]  # pandas would make doubles of LONGs beside a null
    sizes = scratch.write(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "source",
                                      F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size")), "sizes")
    by_source = scratch.write(targets(sizes, weights, share, most), "targets")
    per = by_source.select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long").alias("buckets"))
    rounds, most_buckets = 1, per.agg(F.max("buckets")).first()[0] or 1
    while most_buckets > 1:
        rounds, most_buckets = rounds + 1, -(-most_buckets // FANOUT)
    per = F.broadcast(per) if small_enough(per, BROADCAST_ROWS) else per
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mixed = F.xxhash64(F.lit(seed), F.when(~F.col("no_id"), F.col("id")), "text_hash")
    pending = sizes.join(per, sizes["source"].eqNullSafe(per["s"])).select(
        *keys, "size", "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"),
        mixed.alias("h"), F.pmod(F.xxhash64(mixed), F.col("buckets")).alias("bucket"))
    columns = [F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "source", "text_hash", "size", "source_size", "target", "copies"]
    done = None
    for k in range(rounds):
        schema = "id long, no_id boolean, source string, text_hash long, size long, source_size long, target double, base long, p double, h long, bucket long, whole boolean"
        out = scratch.write(pending.groupBy("source", "bucket").applyInPandas(rounder(seed, k, k == rounds - 1), schema), f"round-{k}")
        part = out.where("whole").withColumn("copies", F.when(F.col("size") > 0, F.col("base") + F.round("p").cast("long")).otherwise(0)).select(columns)
        done = part if done is None else done.union(part)
        pending = out.where("not whole").drop("whole").withColumn("bucket", F.expr(f"bucket div {FANOUT}"))
    return done


def apply_mix(docs: DataFrame, scratch: Scratch, **parameters) -> DataFrame:
    """The documents themselves, each as many times as ``mix`` takes it; ``parameters`` are those of ``mix``.

    Null and wordless texts are never taken; rows with a null doc_id or source are taken like any
    other; repeated rows share out what all of them together are taken. All columns are returned as
    they were, whatever their names; an empty table gives no rows.
    """
    names = free_names(docs, "id", "no_id", "source", "no_source", "hash", "total", "rows", "number", "each")
    keys, (total, rows, number, each) = names[:5], names[5:]

    def own(text_hash: Column) -> list[Column]:
        both = [x for c, none in (("doc_id", F.lit(0)), ("source", F.lit(""))) for x in (F.coalesce(F.col(c).cast("long") if c == "doc_id" else F.col(c), none), F.col(c).isNull())]
        return [x.alias(k) for x, k in zip([*both, text_hash], keys)]

    taken = mix(docs, scratch, **parameters).select(*own(F.col("text_hash")), "copies").groupBy(*keys).agg(F.sum("copies").alias(total), F.count("*").alias(rows))
    out = docs.select("*", *own(F.xxhash64("text"))).join(taken.where(F.col(total) > 0).hint("merge"), keys)
    out = out.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))  # dealt as the join is
    share = F.floor(F.col(total) / F.col(rows)) + F.when(F.col(number) <= F.col(total) % F.col(rows), 1).otherwise(0)
    out = out.withColumn(each, share.cast("long")).where(F.col(each) > 0)
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(each))).alias(number)).select(*docs.columns)

"""What the training-data operators share: the shared folder, words, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import find_here, shared_dir

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written under the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        find_here(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete one table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words as LONG; null and empty text count 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """The table for a join that must not broadcast it, whatever size Spark takes it for.

    Spark sizes a table by its compressed files, and one after an explode hardly larger, though it
    has many times the rows: such a table is built whole in the driver's memory.
    """
    return df.hint("merge")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60, broadcast: bool = True) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has LONG columns ``a`` and ``b``. Returns ``node``, ``root`` (smallest node of the
    component) for every node that has an edge to another node. Each half-step is a partial
    aggregate, written out, and an inner join that Spark may split where one node has very many
    edges. The driver sees only one checksum a round, and without ``broadcast`` no joined table either.
    """
    spark, side = scratch.spark, (lambda df: df) if broadcast else shuffled
    cur = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark, old = None, f"{name}-0"
    for i in range(1, max_rounds + 1):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-l{i}")
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        large = both.join(side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where("u <> v").distinct(), f"{name}-L{i}")
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-s{i}")
        # small star: every smaller neighbour, and the node, go to the smallest
        small = large.join(side(low), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        cur = scratch.write(small, f"{name}-{i}")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
        for t in (f"{name}-l{i}", f"{name}-L{i}", f"{name}-s{i}", old):
            scratch.drop(t)
        old = f"{name}-{i}"
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select("v", "v").distinct())

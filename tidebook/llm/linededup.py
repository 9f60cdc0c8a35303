"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

Lines that occur once have no ID and part the sequences. The others are ranked: a suffix's rank at
level k is how many suffixes start with a smaller run of 2**k lines, which is where its interval of
the suffix array begins; suffixes of equal rank form a longest-common-prefix interval of depth
2**k or more. Level k + 1 ranks pairs (rank of a line's suffix, rank of the suffix 2**k lines on).
Suffixes alone in their interval are settled and leave, so work shrinks with each level.

In each interval the first suffix by (doc_id, text hash, line) is the one to keep; for any other,
its run of 2**k lines is a later copy. Overlapping later copies together are one repeated run, and
runs of at least MIN_WORDS words are deleted. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, free_names, word_count

MIN_WORDS = 50
#: Distinct keys that one task ranks, about.
KEYS_A_RANGE = 20_000
LEAST_LONG = -(1 << 63)


def ranked(keys: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """a, b, first and rank of distinct keys (a, b) with n suffixes each, ordered by (a, b).

    Keys are dealt into ranges of (a, b), so that also many that begin with one frequent line are
    parted; within a range they are summed up in order, and the ranges' totals in one small table.
    """
    keys = scratch.write(keys, f"{name}-keys")
    ranges = max(1, -(-keys.count() // KEYS_A_RANGE))
    dealt = keys.repartitionByRange(ranges, "a", "b").withColumn("part", F.spark_partition_id())
    dealt = scratch.write(dealt, f"{name}-ranges")
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, "part")
    out = scratch.write(out.select("a", "b", "first", (F.col("base") + F.col("within")).alias("rank")), f"{name}-ranks")
    scratch.drop(f"{name}-keys")
    scratch.drop(f"{name}-ranges")
    return out


def later_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated runs to delete: d (doc_id, or the least LONG for null), text_hash, start, end (exclusive), words."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = docs.select(F.coalesce("doc_id", F.lit(LEAST_LONG)).cast("long").alias("d"), F.xxhash64("text").alias("text_hash"), line)
    lines = lines.select("d", "text_hash", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), word_count(F.col("line")).alias("w"))
    lines = scratch.write(lines, "lines")
    place = F.struct("d", "text_hash", "pos")

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")

    ranks = ranked(repeated(lines), scratch, "l0")  # of 128 bits of hash
    rows = lines.join(ranks, ["a", "b"]).dropDuplicates(["d", "text_hash", "pos"])
    rows = scratch.write(rows.select("d", "text_hash", "pos", "w", F.col("rank").alias("r"), (place > F.col("first")).alias("late")), "s0")
    runs, size, level = rows.where("late").select("d", "text_hash", "pos", "w", (F.col("pos") + 1).alias("end")), 1, 0
    while True:
        onward = rows.select("d", "text_hash", (F.col("pos") - size).alias("pos"), F.col("r").alias("b"))
        pairs = rows.select("d", "text_hash", "pos", "w", F.col("r").alias("a")).join(onward, ["d", "text_hash", "pos"])
        pairs = scratch.write(pairs, f"p{level + 1}")
        level, size = level + 1, size * 2
        ranks = ranked(repeated(pairs), scratch, f"l{level}")
        if ranks.isEmpty():
            break
        rows = pairs.join(ranks, ["a", "b"])
        rows = scratch.write(rows.select("d", "text_hash", "pos", "w", F.col("rank").alias("r"), (place > F.col("first")).alias("late")), f"s{level}")
        runs = runs.union(rows.where("late").select("d", "text_hash", "pos", "w", F.col("pos") + size))
    runs = runs.groupBy("d", "text_hash", "pos").agg(F.max("end").alias("end"), F.first("w").alias("w"))
    by_doc = Window.partitionBy("d", "text_hash").orderBy("pos")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.coalesce(F.col("pos") < reach, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(by_doc))
    runs = runs.groupBy("d", "text_hash", "run").agg(F.min("pos").alias("start"), F.max("end").alias("end"), F.sum("w").alias("words"))
    return runs.where(F.col("words") >= min_words).drop("run")


def deduplicate(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, name: str = "removed") -> DataFrame:
    """``docs`` with its text without later copies, and ``name``: array of (start, end, words) over its lines.

    Lines end at "\\n". The first copy by (doc_id, text hash, line) stays; null doc_id comes first.
    Of rows equal in doc_id and text all but one count as later copies as a whole, if they have
    ``min_words`` words. Null and empty texts stay as they are, and so does every text without
    such a run. A text all of whose lines go becomes empty. Other columns are kept as they were; one
    named like the new column ``name`` is replaced. An empty table gives no rows.
    """
    runs = scratch.write(later_runs(docs, scratch, min_words), "runs")
    key, text_hash, gone, again, number = free_names(docs, "key", "text_hash", "gone", "again", "number")
    by_doc = runs.groupBy("d", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "words"))).alias("r"))  # a document's own
    firsts = scratch.spark.read.parquet(scratch.path("lines")).where("pos = 0")
    many = firsts.groupBy("d", "text_hash").agg(F.count("*").alias("c")).where("c > 1")
    both = scratch.write(by_doc.join(many, ["d", "text_hash"], "full"), "by-doc")
    right = both.select(F.col("d").alias(key), F.col("text_hash").alias(text_hash), F.col("r").alias(gone), (F.coalesce("c", F.lit(1)) > 1).alias(again))
    none = F.array().cast("array<struct<start:int,end:int,words:bigint>>")
    out = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias(key), F.xxhash64("text").alias(text_hash))
    out = out.join(right.hint("merge"), [key, text_hash], "left").withColumn(gone, F.coalesce(gone, none))
    if not many.isEmpty():
        # of equal rows all but one go whole; a mark for those alone, so that other rows are not dealt by their key again
        words = word_count(F.col("text"))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.size(F.split("text", "\n", -1)).alias("end"), words.alias("words"))).cast("array<struct<start:int,end:int,words:bigint>>")
        out = out.withColumn(number, F.when(F.col(again), F.row_number().over(Window.partitionBy(key, text_hash).orderBy(F.lit(1)))))
        out = out.withColumn(gone, F.when((F.col(number) > 1) & (words >= min_words), whole).otherwise(F.col(gone)))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists(gone, lambda r: (i >= r["start"]) & (i < r["end"])))
    text = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() != name.lower()], F.col(gone).alias(name))

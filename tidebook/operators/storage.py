"""History on disk: reading with pruning, segments, retention and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.hashes import crc32c_column
from tidebook.schema import COLUMNS, FLAT, KEY, SEGMENT_NS, bucket

STORED = T.StructType([*FLAT.fields, T.StructField("segment", T.LongType())])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Level rows of partitioned history, with the partition column segment."""
    return spark.read.schema(STORED).parquet(path)


def scan(history: DataFrame, start_ns: int, end_ns: int, symbol: str, exchange: str) -> DataFrame:
    """Rows of a book between two times, both included; with ``segment`` there, only its segments are opened."""
    out = history.where((F.col("symbol") == symbol) & (F.col("exchange") == exchange) & F.col("timestamp_ns").between(start_ns, end_ns))
    if "segment" in history.columns:
        out = out.where(F.col("segment").between(start_ns - start_ns % SEGMENT_NS, end_ns))
    return out.select(*COLUMNS)


def segments(flat: DataFrame) -> DataFrame:
    """One row a book and segment: first and last time, rows and first price by arrival."""
    first = F.min_by("price", F.struct("arrival", "level"))
    return flat.groupBy(*KEY, bucket().alias("segment")).agg(F.min("timestamp_ns").alias("start_ts_ns"), F.max("timestamp_ns").alias("end_ts_ns"), F.count("*").alias("row_count"), first.alias("first_price"))


def expired(found: DataFrame, cutoff_ns: int) -> DataFrame:
    """Segments that ended before the cutoff; cutoff 0 or less expires nothing."""
    return found.where((F.col("end_ts_ns") < cutoff_ns) & F.lit(cutoff_ns > 0))


def delete_expired(spark: SparkSession, path: str, cutoff_ns: int) -> tuple[int, int]:
    """Delete the partitions of expired segments, oldest first; returns how many and their bytes.

    The list that the driver goes through is one name a deleted segment.
    """
    gone = expired(segments(read_history(spark, path)), cutoff_ns).orderBy("end_ts_ns").select(*KEY, "segment")
    jvm, conf, n, size = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0, 0
    for r in gone.toLocalIterator():
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/symbol={escape(r['symbol'])}/exchange={escape(r['exchange'])}/segment={r['segment']}")
        store = at.getFileSystem(conf)
        length = store.getContentSummary(at).getLength()
        if store.delete(at, True):
            n, size = n + 1, size + length
    return n, size


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path (below ``path``), size and crc32c of every file of history."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    relative = F.regexp_extract("path", r"(symbol=.*)$", 1)
    return files.select(F.when(relative == "", F.col("path")).otherwise(relative).alias("path"), F.col("length").alias("size"), crc32c_column("content").alias("crc32c"))


def manifest_json(files: DataFrame, total_rows: int, created_at_ns: int) -> str:
    """A manifest as JSON with sorted names; files sorted by path."""
    rows = [r.asDict() for r in files.orderBy("path").toLocalIterator()]
    return json.dumps({"created_at_ns": created_at_ns, "files": rows, "total_bytes": sum(r["size"] for r in rows), "total_rows": total_rows, "wal_byte_offset": 0, "wal_file_index": 0}, sort_keys=True, separators=(",", ":"))

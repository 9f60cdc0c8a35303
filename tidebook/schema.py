"""Row shapes and limits.

Quantities and prices are LONG; unsigned values from 2**63 up do not fit and are rejected where
rows enter. Times are LONG nanoseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEVELS = 1000
SEGMENT_NS = 3_600_000_000_000
LONG_MAX = (1 << 63) - 1
KEY = ["symbol", "exchange"]

LEVEL = T.StructType([T.StructField(n, T.LongType()) for n in ("price", "qty", "cnt")])
#: One row a delta: one side of one book, with the levels it changes.
DELTA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("exchange", T.StringType()), T.StructField("sequence_number", T.LongType()),
    T.StructField("timestamp_ns", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("levels", T.ArrayType(LEVEL)), T.StructField("arrival", T.LongType())])
#: One row a level: what history holds.
FLAT = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("exchange", T.StringType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("sequence_number", T.LongType()),
    T.StructField("side", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("price", T.LongType()), T.StructField("quantity", T.LongType()),
    T.StructField("order_count", T.LongType()), T.StructField("arrival", T.LongType())])
COLUMNS = FLAT.fieldNames()


class TidebookError(Exception):
    """An error with one of the STATUS codes."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status, self.code = status, STATUS[status]


# Status codes.
STATUS = {"OK": 0, "INVALID_ARG": -1, "NOT_FOUND": -2, "PARSE": -3, "IO": -4, "MMAP_FAILED": -5, "OVERFLOW": -6, "CHECKSUM": -7, "FULL": -8, "MIGRATED": -9, "INTERNAL": -99}


def flatten(deltas: DataFrame) -> DataFrame:
    """Delta rows to level rows; level is the position inside the delta, at most MAX_LEVELS are taken."""
    taken = F.slice("levels", 1, MAX_LEVELS)
    return deltas.select("symbol", "exchange", "timestamp_ns", "sequence_number", "side", F.posexplode(taken).alias("level", "l"), "arrival").select(
        "symbol", "exchange", "timestamp_ns", "sequence_number", "side", "level", F.col("l.price").alias("price"), F.col("l.qty").alias("quantity"), F.col("l.cnt").alias("order_count"), "arrival")


def bucket(timestamp_ns: str = "timestamp_ns") -> Column:
    """Start of the segment that a time falls in."""
    return F.expr(f"{timestamp_ns} - pmod({timestamp_ns}, {SEGMENT_NS}L)")


def event_time(timestamp_ns: str = "timestamp_ns") -> Column:
    """Time as TIMESTAMP (microseconds), for windows and watermarks."""
    return F.expr(f"timestamp_micros({timestamp_ns} div 1000)")

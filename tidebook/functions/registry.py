"""Hash ring and codec as functions of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidebook import find_here
from tidebook.functions import codec, hashes
from tidebook.operators.placement import Ring


def register(spark: SparkSession, ring: Ring | None = None) -> None:
    """Make crc32c_of, murmur3_of, zigzag, unzigzag, simple8b_words and simple8b_values known to the session's SQL.

    With a ring also shard_of_hash and shard_of (of a key "symbol.exchange"). Null gives null.
    """
    find_here(spark)
    for name, function in (("crc32c_of", hashes.crc32c_column), ("murmur3_of", hashes.murmur3_column),
                           ("simple8b_words", codec.simple8b_words), ("simple8b_values", codec.simple8b_values)):
        spark.udf.register(name, function)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION zigzag(x BIGINT) RETURNS BIGINT RETURN shiftleft(x, 1) ^ shiftright(x, 63)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION unzigzag(x BIGINT) RETURNS BIGINT RETURN shiftrightunsigned(x, 1) ^ -(x & 1L)")
    if ring is not None:
        spark.udf.register("shard_of_hash", ring.function())
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION shard_of(k STRING) RETURNS STRING RETURN shard_of_hash(murmur3_of(k))")

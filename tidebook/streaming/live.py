"""Standing subscriptions and the live book over streams of level rows.

Arrival order counts, as in batch: there is no watermark, and a late row just overwrites. The live
book is one streaming aggregate, the last row of each price, so its state is one row a price and
spreads over the cluster by price; ranks and metrics are read from what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.functions.metrics import PRICE_SCALE, quotient
from tidebook.operators import book as books
from tidebook.plans.dialect import Query, parse
from tidebook.plans.planner import matching
from tidebook.schema import KEY, event_time
from tidebook.sources.writers import json_rows


def subscribe(stream: DataFrame, sql: str | Query, strict: bool = True) -> DataFrame:
    """JSON rows of a subscription, one for each level row that matches."""
    return json_rows(matching(parse(sql) if isinstance(sql, str) else sql, stream, strict))


def start_subscription(stream: DataFrame, sql: str, on_rows, checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``on_rows(DataFrame, batch number)`` for each batch; stop() of the result ends the subscription."""
    out = subscribe(stream, sql)
    return out.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_rows).trigger(**(trigger or {"processingTime": "1 second"})).start()


def start_live_book(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep changed levels of the live book under ``path``, one folder a batch; a repeated batch overwrites its own."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/at={batch}")

    return books.latest(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "1 second"})).start()


def live_book(spark: SparkSession, path: str) -> DataFrame:
    """The ranked book from what the stream wrote: the newest batch of each price counts."""
    rows = spark.read.parquet(f"{path}/at=*")
    names = ["quantity", "order_count", "timestamp_ns", "sequence_number", "arrival"]
    last = rows.groupBy(*books.SIDE, "price").agg(F.max_by(F.struct(*names), "batch").alias("r")).select(*books.SIDE, "price", "r.*")
    return last.where("quantity > 0").withColumn("level", books.rank())


def windowed_vwap(flat: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Volume-weighted price of the rows of each book and time window; works on streams, with a watermark."""
    timed = flat.withColumn("event_time", event_time())
    if flat.isStreaming:
        timed = timed.withWatermark("event_time", late)
    worth = F.sum(F.col("price").cast("decimal(19,0)") * F.col("quantity").cast("decimal(19,0)"))
    out = timed.where("quantity > 0").groupBy(*KEY, F.window("event_time", width).alias("w")).agg(worth.alias("worth"), F.sum("quantity").alias("quantity"))
    return out.select(*KEY, (F.unix_micros("w.start") * 1000).alias("start_ns"), quotient(F.col("worth") * PRICE_SCALE, F.col("quantity")).alias("vwap"), "quantity")

"""Sources of delta and level rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.schema import COLUMNS, DELTA, LONG_MAX, MAX_LEVELS, TidebookError


def whole(text: Column) -> Column:
    """The number that a text holds as LONG; a fraction is rounded, halves away from zero."""
    return F.coalesce(text.try_cast("long"), F.round(text.cast("decimal(38,18)")).cast("long"))


def event_levels(events: DataFrame) -> DataFrame:
    """The events table as one-level deltas: event type and user as key, value as price, props.k as quantity.

    A time with a zone counts as the instant that it is, one without as UTC, whatever the session's zone.
    """
    zoned = dict(events.dtypes)["ts"] == "timestamp"
    micros = F.unix_micros("ts") if zoned else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events.select(
        F.col("event_type").alias("symbol"), F.concat(F.lit("X"), F.col("user_id") % 3).alias("exchange"),
        (micros * 1000).alias("timestamp_ns"),
        F.col("event_id").alias("sequence_number"), (F.col("event_id") % 2).cast("int").alias("side"), F.lit(0).alias("level"),
        F.expr("cast(round(value * 100) as bigint) div 25").alias("price"), whole(F.get_json_object("props", "$.k")).alias("quantity"),
        (F.col("user_id") % 5 + 1).alias("order_count"), F.col("event_id").alias("arrival"))


def event_deltas(events: DataFrame) -> DataFrame:
    """The events table as nested deltas."""
    levels = F.array(F.struct("price", F.col("quantity").alias("qty"), F.col("order_count").alias("cnt")))
    return event_levels(events).select("symbol", "exchange", "sequence_number", "timestamp_ns", "side", levels.alias("levels"), "arrival")


def parallel_arrays(rows: DataFrame) -> DataFrame:
    """Deltas whose levels come as prices, qtys and cnts arrays of equal length."""
    zipped = F.transform(F.arrays_zip("prices", "qtys", "cnts"), lambda x: F.struct(x["prices"].alias("price"), x["qtys"].alias("qty"), x["cnts"].alias("cnt")))
    fine = (F.size("prices") == F.size("qtys")) & (F.size("prices") == F.size("cnts")) & F.col("side").isin(0, 1)
    return rows.where(fine).select("symbol", "exchange", "sequence_number", "timestamp_ns", "side", F.slice(zipped, 1, MAX_LEVELS).alias("levels"), "arrival")


def read_csv(spark: SparkSession, path: str, now_ns: int = 0) -> tuple[DataFrame, DataFrame]:
    """(level rows, rejected lines) of CSV files symbol,exchange,side,price,qty[,count[,timestamp_ns]] with a header.

    The header is any line that begins symbol,exchange,side: a book named symbol is none. Count is 1 and time ``now_ns`` where left out; any side but ask is bid; a line with a missing
    or malformed field is rejected. Arrival follows file and line order.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("arrival"))
    part = F.transform(F.split("value", ","), lambda x: F.trim(x))
    lines = lines.where(~F.lower(F.regexp_replace("value", r"\s", "")).startswith("symbol,exchange,side,") & (F.trim("value") != "")).withColumn("p", part)
    at = lambda i: F.get("p", F.lit(i))
    blank = lambda i: F.coalesce(at(i), F.lit("")) == ""
    rows = lines.select(
        at(0).alias("symbol"), at(1).alias("exchange"), F.when(blank(6), F.lit(now_ns)).otherwise(at(6).try_cast("long")).alias("timestamp_ns"), F.lit(0).cast("long").alias("sequence_number"),
        F.when(F.lower(at(2)) == "ask", 1).otherwise(0).alias("side"), F.lit(0).alias("level"), at(3).try_cast("long").alias("price"), at(4).try_cast("long").alias("quantity"),
        F.when(blank(5), F.lit(1)).otherwise(at(5).try_cast("long")).alias("order_count"), "arrival", "value", (blank(0) | blank(1) | blank(2)).alias("short"))
    bad = F.col("short") | F.col("price").isNull() | F.col("quantity").isNull() | F.col("order_count").isNull() | F.col("timestamp_ns").isNull() | (F.col("quantity") < 0)
    return rows.where(~bad).select(*COLUMNS), rows.where(bad).select("value")


def generate(spark: SparkSession, symbol: str, exchange: str, n: int, base_ns: int = 0) -> DataFrame:
    """n one-level deltas, bids and asks in turn, around a spread of 10000."""
    i = F.col("id")
    return spark.range(n).select(
        F.lit(symbol).alias("symbol"), F.lit(exchange).alias("exchange"), (F.lit(base_ns) + i * 1000).alias("timestamp_ns"), (i + 1).alias("sequence_number"), (i % 2).cast("int").alias("side"), F.lit(0).alias("level"),
        F.when(i % 2 == 0, 6500000 - (i % 100) * 100).otherwise(6510000 + (i % 100) * 100).alias("price"), (100 + i % 500).alias("quantity"), F.lit(1).cast("long").alias("order_count"), i.alias("arrival"))


def bulk(spark: SparkSession, symbol: str, exchange: str, side: str, n: int, base_price: int, base_qty: int, timestamp_ns: int = 0) -> DataFrame:
    """One delta of n levels, 100 apart and away from the spread, quantities rising by 10."""
    if not 1 <= n <= MAX_LEVELS:
        raise TidebookError("INVALID_ARG", f"a delta has 1 to {MAX_LEVELS} levels")
    step = 100 if side == "ask" else -100
    levels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.struct((base_price + i * step).alias("price"), (base_qty + i * 10).alias("qty"), F.lit(1).cast("long").alias("cnt")))
    return spark.range(1).select(F.lit(symbol).alias("symbol"), F.lit(exchange).alias("exchange"), F.lit(1).cast("long").alias("sequence_number"), F.lit(timestamp_ns).cast("long").alias("timestamp_ns"),
                                 F.lit(int(side == "ask")).alias("side"), levels.alias("levels"), F.lit(0).cast("long").alias("arrival"))


@dataclass
class Parsed:
    """Deltas (symbol, exchange, side, levels) that command lines hold, and the lines that are none."""

    deltas: list[tuple[str, str, int, list[tuple[int, int, int]]]] = field(default_factory=list)
    rejects: list[str] = field(default_factory=list)


def parse_commands(lines: Iterable[str]) -> Parsed:
    """Parse INSERT lines, and MINSERT lines followed by their level lines; a bad level line rejects its whole batch."""

    def level(words: list[str]) -> tuple[int, int, int] | None:
        try:
            price, qty, cnt = int(words[0]), int(words[1]), int(words[2]) if len(words) > 2 else 1
        except (ValueError, IndexError):
            return None
        return (price, qty, cnt) if abs(price) <= LONG_MAX and 0 <= qty <= LONG_MAX and 0 <= cnt < 1 << 32 else None

    out, rest = Parsed(), iter(lines)
    for line in rest:
        words = line.split()
        if not words:
            continue
        verb, side = words[0].upper(), words[3].lower() if len(words) > 3 else ""
        if verb == "INSERT" and side in ("bid", "ask") and (one := level(words[4:7])):
            out.deltas.append((words[1], words[2], int(side == "ask"), [one]))
        elif verb == "MINSERT" and side in ("bid", "ask") and len(words) > 4 and words[4].isdecimal() and 1 <= int(words[4]) <= MAX_LEVELS:
            payload = [x for _, x in zip(range(int(words[4])), rest)]
            levels = [level(x.split()) for x in payload]
            if len(levels) == int(words[4]) and None not in levels:
                out.deltas.append((words[1], words[2], int(side == "ask"), levels))
            else:
                out.rejects += [line, *payload]
        else:
            out.rejects.append(line)
    return out


def command_deltas(spark: SparkSession, parsed: Parsed, now_ns: int, first_sequence: int = 1) -> DataFrame:
    """Parsed commands as delta rows, sequence numbers and arrival counting up."""
    return spark.createDataFrame([(s, e, first_sequence + i, now_ns, side, levels, first_sequence + i) for i, (s, e, side, levels) in enumerate(parsed.deltas)], DELTA)

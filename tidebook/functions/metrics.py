"""Depth metrics of a ranked book, as aggregate columns.

Prices keep their unit; VWAP and mid are times 10**6, imbalance times 10**9, all truncated toward
zero. Each metric gives a value (0 where undefined, or where its levels have no price) and whether it
was undefined: had no levels to read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.schema import KEY

PRICE_SCALE = 1_000_000
RATIO_SCALE = 1_000_000_000
NAMES = ("SUM", "AVG", "MIN", "MAX", "VWAP", "SPREAD", "MID_PRICE", "IMBALANCE", "DEPTH", "DEPTH_RANGE", "CUMULATIVE_VOLUME")
#: How many integer arguments a metric takes; the others take a column or *.
INTEGERS = {"IMBALANCE": 1, "DEPTH": 1, "DEPTH_RANGE": 2, "CUMULATIVE_VOLUME": 1}


@dataclass(frozen=True)
class Metric:
    """A call such as IMBALANCE(10): ``side`` is what single-sided metrics read, ``name`` the output column."""

    function: str
    arguments: tuple[int, ...] = ()
    side: int = 0
    name: str = ""

    @property
    def column(self) -> str:
        return self.name or "_".join([self.function.lower(), *(str(a).replace("-", "m") for a in self.arguments)])

    def columns(self) -> list[Column]:
        value, empty = self.value()
        return [F.coalesce(F.when(~empty, value), F.lit(0)).cast("long").alias(self.column), empty.alias(f"{self.column}_empty")]

    def value(self) -> tuple[Column, Column]:
        own, price, qty = F.col("side") == self.side, F.col("price"), F.col("quantity")
        count, level = F.count(F.when(own, 1)), F.col("level")
        wide = lambda c: c.cast("decimal(19,0)")  # a LONG whose sum may be more than one
        bid, ask = F.max(F.when(F.col("side") == 0, price)), F.min(F.when(F.col("side") == 1, price))
        one_sided = bid.isNull() | ask.isNull()
        if self.function == "SUM":
            return F.sum(F.when(own, qty)), count == 0
        if self.function == "AVG":
            return quotient(F.sum(F.when(own, wide(price))), F.nullif(count, F.lit(0))), count == 0
        if self.function == "MIN":
            return F.min(F.when(own, price)), count == 0
        if self.function == "MAX":
            return F.max(F.when(own, price)), count == 0
        if self.function == "VWAP":
            total = F.coalesce(F.sum(F.when(own, wide(qty))), F.lit(0))
            worth = F.sum(F.when(own, wide(price) * wide(qty)))
            return quotient(worth * PRICE_SCALE, F.nullif(total, F.lit(0))), total == 0
        if self.function == "SPREAD":
            return ask - bid, one_sided
        if self.function == "MID_PRICE":
            return quotient((ask + bid) * PRICE_SCALE, F.lit(2)), one_sided
        if self.function == "IMBALANCE":
            n = self.arguments[0] if self.arguments and self.arguments[0] > 0 else None
            near = level < n if n else F.lit(True)
            bids = F.coalesce(F.sum(F.when((F.col("side") == 0) & near, wide(qty))), F.lit(0))
            # without n each side is read as deep as the bids go
            deep = F.count(F.when(F.col("side") == 0, 1))
            asks = F.coalesce(F.sum(F.when((F.col("side") == 1) & near, wide(qty))), F.lit(0)) if n else F.aggregate(
                F.slice(F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.struct("level", "quantity")))), F.lit(1), deep), F.lit(0).cast("decimal(29,0)"), lambda a, x: (a + x["quantity"]).cast("decimal(29,0)"))  # a row each price of one side
            both = F.coalesce(F.sum(F.when(near, wide(qty))), F.lit(0)) if n else bids + asks  # a row of neither side counts here
            return quotient((bids - asks).cast("decimal(28,0)") * RATIO_SCALE, F.nullif(both, F.lit(0))), both == 0
        if self.function == "DEPTH":
            return F.coalesce(F.sum(F.when(own & (price == self.arguments[0]), qty)), F.lit(0).cast("long")), F.lit(False)
        if self.function == "DEPTH_RANGE":
            inside = own & price.between(*self.arguments)
            return F.sum(F.when(inside, qty)), F.count(F.when(inside, 1)) == 0
        if self.function == "CUMULATIVE_VOLUME":
            n = self.arguments[0] if self.arguments and self.arguments[0] > 0 else None
            return F.sum(F.when(own & (level < n) if n else own, qty)), count == 0
        raise ValueError(f"no metric {self.function}")


def quotient(a: Column, b: Column) -> Column:
    """Integer quotient toward zero; null where the divisor is."""
    return F.call_function("div", a, b)


def measure(book: DataFrame, metrics: Sequence[Metric], keys: Sequence[str] = KEY) -> DataFrame:
    """All metrics of each book in one aggregation over a ranked book."""
    return book.groupBy(*keys).agg(*[c for m in metrics for c in m.columns()])


def cumulative_levels(book: DataFrame) -> DataFrame:
    """The book with cum_quantity: quantity from the best level to this one."""
    upto = Window.partitionBy(*KEY, "side").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return book.withColumn("cum_quantity", F.sum("quantity").over(upto))

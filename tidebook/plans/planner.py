"""From parsed queries to DataFrames over level rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.metrics import measure
from tidebook.operators import book as books
from tidebook.plans.dialect import Query, parse
from tidebook.schema import LONG_MAX, SEGMENT_NS, TidebookError

#: Columns of SELECT *, in order, and the stored column of each.
STAR = {"timestamp": "timestamp_ns", "price": "price", "quantity": "quantity", "order_count": "order_count", "side": "side", "level": "level", "sequence_number": "sequence_number"}


def clamp(x: int) -> int:
    """A literal within LONG, so that comparisons stay LONG and reach the Parquet scan."""
    return max(-LONG_MAX - 1, min(LONG_MAX, x))


def on_key(q: Query) -> Column:
    return (F.col("symbol") == q.symbol) & (F.col("exchange") == q.exchange)


def on_bounds(q: Query, columns: list[str], strict: bool = True) -> Column:
    """Time and price bounds, with the segments they imply where rows carry them."""
    out = F.lit(True)
    for name, stored in (("timestamp", "timestamp_ns"), ("price", "price")):
        low, high = q.bounds(name, strict)
        if low is not None:
            out &= F.col(stored) >= clamp(low)
        if high is not None:
            out &= F.col(stored) <= clamp(high)
        if name == "timestamp" and "segment" in columns:
            if low is not None:
                out &= F.col("segment") >= clamp(low) - clamp(low) % SEGMENT_NS
            if high is not None:
                out &= F.col("segment") <= clamp(high)
    return out


def project(rows: DataFrame, q: Query) -> DataFrame:
    return rows.select(*[F.col(STAR[c]).alias(c) for c in (q.columns or STAR)])


def plan(q: Query | str, flat: DataFrame, strict: bool = True, check_key: bool = False) -> DataFrame:
    """The result of a SELECT over level rows.

    Rows come in (segment, arrival) order where LIMIT cuts; without it no order is promised, so
    that a scan needs no shuffle. Metrics read the live book, or with AT the book as of then; other
    conditions beside metrics are rejected unless ``strict`` is off, when they are ignored.
    ``check_key`` looks whether the book exists and raises NOT_FOUND if not.
    """
    q = parse(q) if isinstance(q, str) else q
    if q.kind != "SELECT":
        raise TidebookError("INVALID_ARG", "a subscription is not executed but subscribed")
    own = flat.where(on_key(q))
    if check_key and own.isEmpty():
        raise TidebookError("NOT_FOUND", f"no book '{q.symbol}'.'{q.exchange}'")
    if q.metrics:
        if q.conditions and strict:
            raise TidebookError("INVALID_ARG", "metrics read the book; only AT goes with them")
        levels = books.book(own) if q.at_ns is None else books.book_at(own, clamp(q.at_ns))
        out = measure(levels, q.metrics)
        return out if q.limit is None else out.limit(q.limit)
    if q.at_ns is not None:
        rows = books.snapshot_at(own, clamp(q.at_ns)).where(on_bounds(q, [], strict))
    else:
        rows = own.where(on_bounds(q, own.columns, strict))
    if q.limit is not None:
        rows = rows.orderBy(F.expr(f"timestamp_ns - pmod(timestamp_ns, {SEGMENT_NS}L)"), "arrival", "level").limit(q.limit)
    return project(rows, q)


def matching(q: Query | str, flat: DataFrame, strict: bool = True) -> DataFrame:
    """Rows that a subscription fires for; works on streams. Metrics in the list are ignored."""
    q = parse(q) if isinstance(q, str) else q
    return flat.where(on_key(q) & on_bounds(q, [], strict))



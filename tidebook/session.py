"""A book store on a folder: insert, query, subscribe."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import book as books
from tidebook.operators import storage
from tidebook.plans import planner
from tidebook.plans.dialect import parse
from tidebook.schema import DELTA, FLAT, LONG_MAX, MAX_LEVELS, TidebookError, bucket, flatten
from tidebook.sources import readers, writers


class Store:
    """History under ``path`` and deltas not yet flushed; every query sees both."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pending, self.sequence = spark, path.rstrip("/"), [], 0
        known = self._stored()
        if known is not None:
            self.sequence = known.agg(F.max(F.greatest("sequence_number", "arrival"))).first()[0] or 0

    def _stored(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return storage.read_history(self.spark, self.path) if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None

    def insert(self, symbol: str, exchange: str, side: str, prices: Sequence[int], qtys: Sequence[int], counts: Sequence[int] | None = None,
               timestamp_ns: int | None = None, seq: int | None = None) -> int:
        """Add one delta; returns its sequence number. Without ``seq`` the next one is given."""
        counts = list(counts) if counts is not None else [1] * len(prices)
        if not len(prices) == len(qtys) == len(counts):
            raise ValueError("prices, qtys and counts must be of one length")
        if not 1 <= len(prices) <= MAX_LEVELS:
            raise ValueError(f"a delta has 1 to {MAX_LEVELS} levels")
        if any(not 0 <= q <= LONG_MAX for q in qtys):
            raise TidebookError("OVERFLOW", "quantities are 0 to 2**63 - 1")
        if max(len(symbol.encode()), len(exchange.encode())) > 31:
            raise TidebookError("INVALID_ARG", "symbol and exchange have at most 31 bytes")
        seq = self.sequence + 1 if seq is None else seq
        self.sequence = max(self.sequence + 1, seq)
        self.pending.append((symbol, exchange, seq, time.time_ns() if timestamp_ns is None else timestamp_ns, int(side.lower() == "ask"), [tuple(map(int, x)) for x in zip(prices, qtys, counts)], self.sequence))
        return seq

    def run_commands(self, lines: Sequence[str]) -> list[str]:
        """INSERT and MINSERT lines; returns the rejected ones."""
        parsed = readers.parse_commands(lines)
        for symbol, exchange, side, levels in parsed.deltas:
            self.insert(symbol, exchange, ("bid", "ask")[side], *map(list, zip(*levels)))
        return parsed.rejects

    def load_csv(self, path: str) -> int:
        """Append the rows of CSV files to history; returns how many lines were rejected."""
        good, bad = readers.read_csv(self.spark, path, time.time_ns())
        last = self.sequence
        writers.write_history(good.withColumn("arrival", F.col("arrival") + last + 1), self.path)
        self.sequence = self._stored().agg(F.max("arrival")).first()[0] or last
        return bad.count()

    def flush(self) -> None:
        """Write pending deltas to history."""
        if self.pending:
            writers.write_history(flatten(self.spark.createDataFrame(self.pending, DELTA)), self.path)
            self.pending = []

    def rows(self) -> DataFrame:
        stored = self._stored()
        fresh = flatten(self.spark.createDataFrame(self.pending, DELTA)) if self.pending else None
        if stored is None:
            return fresh if fresh is not None else self.spark.createDataFrame([], FLAT)
        if fresh is None:
            return stored
        return stored.unionByName(fresh.withColumn("segment", bucket()))

    def query(self, sql: str, strict: bool = True) -> DataFrame:
        return planner.plan(sql, self.rows(), strict, check_key=True)

    def query_all(self, symbol: str, exchange: str, limit: int | None = None) -> DataFrame:
        cut = "" if limit is None else f" LIMIT {limit}"
        return self.query(f"SELECT * FROM '{symbol}'.'{exchange}' WHERE timestamp BETWEEN 0 AND {LONG_MAX}{cut}")

    def query_many(self, sql: str, keys: Sequence[tuple[str, str]]) -> DataFrame:
        """One SELECT over several books, rows of all by time."""
        q, out = parse(sql), None
        for symbol, exchange in keys:
            part = planner.plan(replace(q, symbol=symbol, exchange=exchange), self.rows()).withColumns({"symbol": F.lit(symbol), "exchange": F.lit(exchange)})
            out = part if out is None else out.unionByName(part)
        return out.orderBy("timestamp") if "timestamp" in out.columns else out

    def book(self) -> DataFrame:
        rows = self.rows()
        return books.book(rows) if books.closed_form_holds(rows) else books.exact(rows)

    def status(self) -> dict[str, int]:
        rows = self.rows()
        found = rows.agg(F.count("*"), F.countDistinct("symbol", "exchange")).first()
        return {"sequence_number": self.sequence, "pending_deltas": len(self.pending), "rows": found[0], "books": found[1], "segments": storage.segments(rows).count()}

    def expire(self, ttl_ns: int, now_ns: int | None = None) -> tuple[int, int]:
        """Delete segments older than a time to live; returns how many and their bytes."""
        return storage.delete_expired(self.spark, self.path, max(0, (time.time_ns() if now_ns is None else now_ns) - ttl_ns)) if self._stored() is not None else (0, 0)

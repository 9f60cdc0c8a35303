"""Placement of books on shards by a consistent hash ring."""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.hashes import murmur3, murmur3_column
from tidebook.schema import TidebookError


def symbol_key() -> Column:
    return F.concat_ws(".", "symbol", "exchange")


class Ring:
    """Shards with their virtual nodes; a later shard takes a point that two claim."""

    def __init__(self, shards: Mapping[str, int]):
        points: dict[int, str] = {}
        for shard, nodes in shards.items():
            points |= {murmur3(f"{shard}#{i}".encode()): shard for i in range(nodes)}
        self.shards, self.points = dict(shards), sorted(points)
        self.owners = [points[p] for p in self.points]

    def without(self, shard: str) -> Ring:
        return Ring({s: n for s, n in self.shards.items() if s != shard})

    def lookup(self, key: str) -> str | None:
        """The shard of the first point at or after the key's hash, going round."""
        if not self.points:
            return None
        return self.owners[bisect.bisect_left(self.points, murmur3(key.encode())) % len(self.points)]

    def of_hash(self, hashed: Column) -> Column:
        """The shard of a column of hashes."""
        return self.function()(hashed)

    def function(self) -> Callable[[Column], Column]:
        """What gives the shard of a hash; the ring (a few nodes a shard) travels with it."""
        points, owners = np.array(self.points, np.int64), np.array(self.owners, object)

        @F.pandas_udf("string")
        def find(h: pd.Series) -> pd.Series:
            if not len(points):
                return pd.Series([None] * len(h), dtype=object)
            return pd.Series(owners[np.searchsorted(points, h.to_numpy(np.int64), side="left") % len(points)])

        return find


def assign(keys: DataFrame, ring: Ring) -> DataFrame:
    """Distinct (symbol_key, hash, shard) of rows with symbol and exchange."""
    return keys.select(symbol_key().alias("symbol_key")).distinct().withColumn("hash", murmur3_column("symbol_key")).withColumn("shard", ring.of_hash(F.col("hash")))


def reassign(old: DataFrame, ring: Ring) -> DataFrame:
    """symbol_key, old_shard and new_shard of keys that the ring places elsewhere than ``old`` (symbol_key, shard) has them."""
    new = old.withColumn("new_shard", ring.of_hash(murmur3_column("symbol_key")))
    return new.where("new_shard <> shard").select("symbol_key", F.col("shard").alias("old_shard"), "new_shard")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """How assignments (symbol_key, shard) differ: added, removed or moved."""
    a, b = old.select("symbol_key", F.col("shard").alias("old_shard")), new.select("symbol_key", F.col("shard").alias("new_shard"))
    change = F.when(F.col("old_shard").isNull(), "added").when(F.col("new_shard").isNull(), "removed").otherwise("moved")
    both = a.join(b, "symbol_key", "full")
    return both.where(~F.col("old_shard").eqNullSafe(F.col("new_shard"))).withColumn("change", change)


def rebalance(current: DataFrame, ring: Ring, pinned: DataFrame) -> DataFrame:
    """Moves that bring keys to the ring's placement, leaving pinned keys where they are."""
    return reassign(current, ring).join(pinned.select("symbol_key"), "symbol_key", "left_anti")


def shard_map_json(version: int, assignments: Mapping[str, str], shards: Mapping[str, Mapping], pinned: list[str] = (), migrations: list[Mapping] = ()) -> str:
    """A shard map as JSON with sorted names."""
    return json.dumps({"active_migrations": list(migrations), "assignments": dict(assignments), "pinned_symbols": sorted(pinned), "shards": {k: dict(v) for k, v in shards.items()}, "version": version}, sort_keys=True, separators=(",", ":"))


def parse_shard_map(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError as e:
        raise TidebookError("PARSE", f"no JSON: {e}") from e
    if not isinstance(found, dict) or not isinstance(found.get("version"), int) or not isinstance(found.get("assignments"), dict) or not isinstance(found.get("shards"), dict):
        raise TidebookError("PARSE", "a shard map has version, assignments and shards")
    missing = {s for s in found["assignments"].values()} - set(found["shards"])
    if missing:
        raise TidebookError("INVALID_ARG", f"assigned to shards that are not there: {', '.join(sorted(missing))}")
    return found

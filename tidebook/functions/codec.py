"""Encodings of history columns: zigzag deltas of prices and Simple8b words of quantities."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Simple8b selectors as (values a word, bits a value).
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
PAYLOAD = (1 << 60) - 1
MARKER = 15 << 60 | PAYLOAD


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1).cast("long")))


def encode_prices(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with ``word``: zigzag of the difference to the price before, of the price itself at first."""
    before = F.coalesce(F.lag("price").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0).cast("long"))
    return rows.withColumn("word", zigzag(F.col("price") - before))


def decode_prices(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with ``decoded``: prices from their words."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("decoded", F.sum(unzigzag(F.col("word"))).over(upto))


def encode_simple8b(values: list[int]) -> list[int]:
    """64-bit words; a value of 2**60 - 1 or more stands alone in the word after a marker."""
    words, at = [], 0
    while at < len(values):
        if values[at] >= PAYLOAD:
            words += [MARKER, values[at]]
            at += 1
            continue
        for selector, (count, bits) in enumerate(SELECTORS):
            part = values[at : at + count]
            if max(part) < 1 << bits:
                words.append(selector << 60 | sum(v << bits * i for i, v in enumerate(part)))
                at += len(part)
                break
    return words


def decode_simple8b(words: list[int], count: int) -> list[int]:
    out, rest = [], iter(words)
    for word in rest:
        if word == MARKER:
            out.append(next(rest))
            continue
        n, bits = SELECTORS[word >> 60]
        out += [word >> bits * i & (1 << bits) - 1 for i in range(n)]
    return out[:count] if len(out) >= count else out


@F.pandas_udf(T.ArrayType(T.DecimalType(20, 0)))
def simple8b_words(values: pd.Series) -> pd.Series:
    """Words of an array of quantities."""
    return pd.Series([None if v is None else [Decimal(w) for w in encode_simple8b([int(x) for x in v])] for v in values])


@F.pandas_udf(T.ArrayType(T.LongType()))
def simple8b_values(words: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else decode_simple8b([int(x) for x in w], int(n)) for w, n in zip(words, count)])

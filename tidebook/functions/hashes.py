"""Hashes that Spark has in another variety: CRC-32C and MurmurHash3 (x86, 32 bits, seed 0)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0x82F63B78), table >> 1)
    return table


CRC_COLUMN = _crc_table()
CRC_TABLE = CRC_COLUMN.tolist()
#: With fewer strings left than this, a step over all of them at once is slower than one after another.
FEW = 16


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = CRC_TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3_x86_32, unsigned."""
    mask, turn = 0xFFFFFFFF, lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h, whole = seed, len(data) // 4 * 4
    mix = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    for at in range(0, whole, 4):
        h = turn(h ^ mix(int.from_bytes(data[at : at + 4], "little")), 13) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def longest_first(rows: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Order of the strings by length, the strings in it, and their lengths."""
    lengths = np.array([len(x) for x in rows], np.int64)
    order = np.argsort(-lengths, kind="stable")
    return order, [rows[i] for i in order], lengths[order]


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """``crc32c`` of each string, a byte of every string at a step."""
    order, rows, lengths = longest_first(rows)
    data, starts = np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lengths) - lengths
    crc, at = np.full(len(rows), 0xFFFFFFFF, np.uint32), 0
    while (n := int(np.searchsorted(-lengths, -at))) >= FEW:  # strings longer than ``at``
        crc[:n] = CRC_COLUMN[(crc[:n] ^ data[starts[:n] + at]) & 255] ^ crc[:n] >> np.uint32(8)
        at += 1
    crc ^= np.uint32(0xFFFFFFFF)
    crc[:n] = [crc32c(x[at:], int(c)) for x, c in zip(rows[:n], crc[:n])]
    out = np.empty(len(rows), np.int64)
    out[order] = crc
    return out


def murmur3_many(rows: list[bytes], seed: int = 0) -> np.ndarray:
    """``murmur3`` of each string, four bytes of every string at a step."""
    order, rows, lengths = longest_first(rows)
    words = np.frombuffer(b"".join(x + bytes(-len(x) % 4) for x in rows), "<u4")
    each = -(-lengths // 4)
    starts, whole = np.cumsum(each) - each, lengths // 4
    turn = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    mix = lambda k: turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = np.full(len(rows), seed, np.uint32)
    for at in range(int(whole[0]) if len(rows) else 0):
        n = int(np.searchsorted(-whole, -at))
        h[:n] = turn(h[:n] ^ mix(words[starts[:n] + at]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = whole < each
    h[rest] ^= mix(words[starts[rest] + whole[rest]])
    h ^= lengths.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out = np.empty(len(rows), np.int64)
    out[order] = h ^ h >> np.uint32(16)
    return out


def _hashed(data: pd.Series, many: Callable[[list[bytes]], np.ndarray]) -> pd.Series:
    there = data.notna().to_numpy()
    out = pd.Series(np.zeros(len(data), np.int64), dtype="Int64")
    out[there] = many([x.encode() if isinstance(x, str) else bytes(x) for x in data[there]])
    out[~there] = pd.NA
    return out


@F.pandas_udf(T.LongType())
def crc32c_column(data: pd.Series) -> pd.Series:
    return _hashed(data, crc32c_many)


@F.pandas_udf(T.LongType())
def murmur3_column(text: pd.Series) -> pd.Series:
    return _hashed(text, murmur3_many)

"""Copies of images by local descriptors.

A picture is scaled down until its longer side has at most SIDE pixels. At each of LEVELS scales every
point whose corner strength is the largest within APART pixels is a corner, so their number grows
with the picture's area and a crop keeps the corners it holds. A corner is placed below the pixel,
has the direction of its patch's centroid, and TESTS brightness tests turned into that direction.

Tables are keyed by pairs: a corner and one of its PARTNERS nearest of the same level, the darker
first, with ``bits`` tests of each. Entries also carry what turning, shifting and scaling leave as it
is (both directions against the line between the two, and its length): pictures are candidates if an
entry has a pair of each and these agree. A candidate pair is a copy if at least INLIERS matched
corners agree on one shift, turn and scale. So crops, resizing, turns and changes of brightness are
found.

Equal files are one picture from the start. Where more than CROWD pairs share an entry, every
picture is first checked against the entry's smallest only; what is then still apart is compared in
blocks. Only candidates are checked in either way, so components are the same whichever an entry
takes; and how tables are laid out follows from ``expected``, not from the pictures there are, so
two pictures meet or not whatever else is in the table.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import tables
from tidebook.llm.common import Scratch, components

SIDE = 512
LEVELS = tuple(0.5 ** (k / 6) for k in range(7))
APART, RADIUS, TESTS = 9, 9, 128
PARTNERS, NEAREST, FARTHEST = 2, 4, 48  # partners of a corner, and their distance in pixels of the level
TURNED, LONGER = 0.35, 0.25  # most by which directions (radians) and logarithms of lengths of an entry's pairs differ
FAR = 26  # of all tests, for a match of two corners of a candidate pair
INLIERS, SLACK = 7, 2.0
CROWD, BLOCK = 64, 1024
EXPECTED = 1 << 16  # pictures that tables are laid out for
MOST_PIXELS = 1 << 28
KINDS = 6
CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("angle", "<i2"), ("level", "u1"), ("tone", "u1"), ("bits", "u1", (TESTS // 8,))])
PLACE, TURN = 64, 10_000  # units of a pixel and of a radian in a CORNER


@functools.cache
def pattern() -> np.ndarray:
    """Both points (x, y) of each test: of random ones those of nearly even outcome over seeded noise that least repeat one another; the first are the best."""
    rng = np.random.default_rng(10)
    noise = blur(rng.normal(size=(3000, 32, 32)).astype(np.float32), 3) + 0.5 * resize(rng.normal(size=(3000, 8, 8)).astype(np.float32), 4)
    which, middle = np.arange(len(noise)), np.full(len(noise), 16.0, np.float32)
    far, way = (RADIUS - 1) * np.sqrt(rng.random((2, 1000))), 2 * np.pi * rng.random((2, 1000))
    points = np.stack([far[0] * np.cos(way[0]), far[0] * np.sin(way[0]), far[1] * np.cos(way[1]), far[1] * np.sin(way[1])], 1)
    found = tested(noise, which, middle, middle, direction(noise, which, middle, middle), points).astype(float)
    uneven, alike = np.abs(found.mean(axis=0) - 0.5), np.abs(np.nan_to_num(np.corrcoef(found.T)))
    order, got, most = np.argsort(uneven, kind="stable"), [], 0.2
    while len(got) < TESTS:
        for t in order:
            if t not in got and len(got) < TESTS and (alike[t, got] < most).all():
                got.append(int(t))
        most += 0.05
    return points[got]


def chosen_tests(tables: int, bits: int) -> np.ndarray:
    """The tests, of the better half, that key each table: of the first and of the second corner."""
    rng = np.random.default_rng(3)
    return np.stack([[rng.permutation(TESTS // 2)[:bits] for _ in range(2)] for _ in range(tables)])


def tables_for(expected: int) -> tuple[int, int]:
    """Tables and tests a corner that keep chance meetings few: both grow with the logarithm of the number of pictures expected."""
    bits = min(TESTS // 2, 16 + math.ceil(math.log2(max(expected, 2)) / 2))
    return bits // 2 - 2, bits


def decode(data: bytes | None) -> np.ndarray | None:
    """Brightness (float32, 0 to 255) of a PGM or PPM (binary, maximum 255) or PNG (8 bits, not interlaced) file.

    None if it is none of these, is cut off, or has over MOST_PIXELS pixels.
    """
    try:
        if data[:2] in (b"P5", b"P6"):
            words, at = [], 2
            while len(words) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                words.append(int(data[at:end]))  # nothing there: ValueError
                at = end
            w, h, top = words
            if top != 255 or w * h > MOST_PIXELS:
                return None
            own = np.frombuffer(data, np.uint8, w * h * (3 if data[:2] == b"P6" else 1), at + 1).reshape(h, w, -1)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body = 8, []
            while at < len(data):
                n, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"IHDR":
                    w, h, depth, color, _, _, lace = struct.unpack_from(">IIBBBBB", data, at + 8)
                    if depth != 8 or lace or color not in (0, 2, 4, 6) or w * h > MOST_PIXELS:
                        return None
                elif kind == b"IDAT":
                    body.append(data[at + 8 : at + 8 + n])
                at += 12 + n
            c = {0: 1, 2: 3, 4: 2, 6: 4}[color]
            rows = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), h * (1 + w * c)), np.uint8).reshape(h, 1 + w * c)
            own = _unfilter(rows, c).reshape(h, w, c)[:, :, : 3 if c > 2 else 1]
        else:
            return None
        return own.astype(np.float32).mean(axis=2) if min(own.shape[:2]) > 0 else None
    except (ValueError, IndexError, TypeError, KeyError, UnboundLocalError, struct.error, zlib.error):
        return None


def _unfilter(rows: np.ndarray, c: int) -> np.ndarray:
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.int32)
    for i, row in enumerate(rows):
        kind, line, up = row[0], row[1:].astype(np.int32), out[i]
        if kind == 2:
            line = line + up
        elif kind == 1:
            line = line.reshape(-1, c).cumsum(axis=0).ravel()
        elif kind in (3, 4):
            line = line.copy()
            for j in range(len(line)):
                a, b, d = (line[j - c] if j >= c else 0), up[j], (up[j - c] if j >= c else 0)
                if kind == 3:
                    line[j] = (line[j] + (a + b) // 2) & 255
                else:
                    p = a + b - d
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                    line[j] = (line[j] + near) & 255
        out[i + 1] = line & 255
    return out[1:].astype(np.uint8)


def encode_pgm(picture: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (picture.shape[1], picture.shape[0]) + np.clip(picture, 0, 255).astype(np.uint8).tobytes()


def resize(p: np.ndarray, scale: float) -> np.ndarray:
    """Pictures (n, h, w) scaled by bilinear sampling."""
    h, w = max(int(p.shape[1] * scale), 1), max(int(p.shape[2] * scale), 1)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, p.shape[1] - 1), np.clip(x, 0, p.shape[2] - 1)
    y0, x0 = np.minimum(y.astype(int), max(p.shape[1] - 2, 0)), np.minimum(x.astype(int), max(p.shape[2] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, p.shape[1] - 1), np.minimum(x0 + 1, p.shape[2] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None, :].astype(np.float32)
    top, low = p[:, y0], p[:, y1]
    return (top[:, :, x0] * (1 - fx) + top[:, :, x1] * fx) * (1 - fy) + (low[:, :, x0] * (1 - fx) + low[:, :, x1] * fx) * fy


def blur(p: np.ndarray, turns: int = 1) -> np.ndarray:
    for _ in range(turns):
        q = np.pad(p, ((0, 0), (1, 1), (0, 0)), mode="edge")
        p = (q[:, :-2] + 2 * q[:, 1:-1] + q[:, 2:]) / 4
        q = np.pad(p, ((0, 0), (0, 0), (1, 1)), mode="edge")
        p = (q[:, :, :-2] + 2 * q[:, :, 1:-1] + q[:, :, 2:]) / 4
    return p


def largest_near(strength: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within ``reach`` rows and columns of each point of pictures (n, h, w)."""
    for axis in (1, 2):
        pad = [(0, 0), (0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        cur, wide = np.pad(strength, pad), 1
        cut = lambda p, a, b: p[:, a:b] if axis == 1 else p[:, :, a:b]
        while wide < 2 * reach + 1:
            step = min(wide, 2 * reach + 1 - wide)
            cur, wide = np.maximum(cut(cur, 0, cur.shape[axis] - step), cut(cur, step, cur.shape[axis])), wide + step
        strength = cur
    return strength


def sampled(p: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of pictures (n, h, w) between their pixels, for places before the last row and column."""
    w = p.shape[2]
    x0, y0 = x.astype(np.int32), y.astype(np.int32)
    fx, fy = x - x0, y - y0
    at, flat = (which.astype(np.int32) * p.shape[1] + y0) * w + x0, p.ravel()
    top, low = flat.take(at), flat.take(at + w)
    top += (flat.take(at + 1) - top) * fx
    low += (flat.take(at + (w + 1)) - low) * fx
    return top + (low - top) * fy


def direction(soft: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle from each corner to the centroid of the disc around it."""
    grid = np.arange(-RADIUS, RADIUS + 1, dtype=np.float32)
    v, u = np.nonzero(grid[:, None] ** 2 + grid[None, :] ** 2 <= RADIUS * RADIUS)
    u, v = grid[u], grid[v]
    disc = sampled(soft, which[:, None], x[:, None] + u, y[:, None] + v)
    return np.arctan2(disc @ v, disc @ u)


def tested(soft: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray, angle: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether the first point of each test is darker than the second, in the directions of the corners."""
    cos, sin = np.cos(angle)[:, None].astype(np.float32), np.sin(angle)[:, None].astype(np.float32)
    points = points.astype(np.float32)
    first, second = [sampled(soft, which[:, None], x[:, None] + points[:, k] * cos - points[:, k + 1] * sin, y[:, None] + points[:, k] * sin + points[:, k + 1] * cos) for k in (0, 2)]
    return first < second


def corners(pictures: np.ndarray) -> list[np.ndarray]:
    """CORNER rows of each of several pictures (n, h, w) of one size."""
    fit = min(1.0, SIDE / max(pictures.shape[1:]))
    pictures = resize(blur(pictures, max(1, round(0.5 / fit))), fit) if fit < 1 else pictures
    out: list[list[np.ndarray]] = [[] for _ in pictures]
    for level, scale in enumerate(LEVELS):
        p = blur(resize(pictures, scale) if scale != 1 else pictures)
        n, h, w = p.shape
        edge = RADIUS + 1
        if min(h, w) <= 2 * edge:
            continue
        gy, gx = np.gradient(p, axis=(1, 2))
        a, b, c = blur(gx * gx, 2), blur(gy * gy, 2), blur(gx * gy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        strength[:, :edge] = strength[:, h - edge :] = 0
        strength[:, :, :edge] = strength[:, :, w - edge :] = 0
        which, y, x = np.nonzero((strength > 1) & (strength >= largest_near(strength, APART)))
        if not len(y):
            continue
        top = strength[which, y, x]
        beside = [strength[which, y + v, x + u] for u, v in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        fx, fy = [np.clip((high - low) / np.maximum(2 * (2 * top - low - high), 1e-9), -0.5, 0.5) for low, high in (beside[:2], beside[2:])]
        fx, fy = (x + fx).astype(np.float32), (y + fy).astype(np.float32)
        soft = blur(p, 4)
        angle = direction(soft, which, fx, fy)
        rows = np.zeros(len(y), CORNER)
        rows["x"], rows["y"] = np.rint(PLACE * ((fx + 0.5) / scale - 0.5)), np.rint(PLACE * ((fy + 0.5) / scale - 0.5))
        rows["angle"], rows["level"], rows["tone"] = np.rint(TURN * angle), level, np.clip(sampled(soft, which, fx, fy), 0, 255)
        rows["bits"] = np.packbits(tested(soft, which, fx, fy, angle, pattern()), axis=1, bitorder="little")
        ends = np.searchsorted(which, np.arange(n + 1))
        for i in np.unique(which):
            out[i].append(rows[ends[i] : ends[i + 1]])
    return [np.concatenate(r) if r else np.zeros(0, CORNER) for r in out]


def places(c: np.ndarray) -> np.ndarray:
    return (c["x"].astype(float) + 1j * c["y"]) / PLACE


def partners(c: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of a corner and one of its PARTNERS nearest of the same level, the darker first; both ways if equally dark."""
    out = [np.zeros((0, 2), np.int64)]
    for level in np.unique(c["level"]):
        at = np.nonzero(c["level"] == level)[0]
        z = places(c[at]) * LEVELS[level]
        for k in range(0, len(at), 1024):
            far = np.abs(z[k : k + 1024, None] - z[None, :])
            far[(far < NEAREST) | (far > FARTHEST)] = np.inf
            for turn in range(min(PARTNERS, len(at) - 1)):
                j = far.argmin(axis=1)
                i = np.nonzero(np.isfinite(far[np.arange(len(j)), j]))[0]
                out.append(np.stack([at[k + i], at[j[i]]], 1))
                far[i, j[i]] = np.inf
    got = np.concatenate(out)
    i, j = got.T
    ti, tj = c["tone"][i].astype(int), c["tone"][j].astype(int)
    return np.unique(np.concatenate([got[ti <= tj + 1], got[tj <= ti + 1][:, ::-1]]), axis=0)


def invariants(c: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What shifting, turning and scaling leave of pairs: both directions against the line from first to second, and the line's length, as int16."""
    i, j = pairs.T
    z = places(c)
    line = z[j] - z[i]
    to, own = np.angle(line), c["angle"] / TURN
    turned = [np.angle(np.exp(1j * (own[k] - to))) for k in (i, j)]
    return np.rint(np.stack([*[t * TURN for t in turned], 1000 * np.log(np.maximum(np.abs(line), 1e-3) * np.array(LEVELS)[c["level"][i]])], 1)).astype(np.int16)


def keys(c: np.ndarray, pairs: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """LONG keys (pairs, tables)."""
    bits = np.unpackbits(c["bits"], axis=1, bitorder="little").astype(np.uint64)
    out = []
    for t, (one, two) in enumerate(tests):
        h = np.full(len(pairs), t + 1, np.uint64)
        for k, chosen in ((0, one), (1, two)):
            h = (h ^ (bits[pairs[:, k]][:, chosen] @ (np.uint64(1) << np.arange(len(chosen), dtype=np.uint64)))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out.append(h.view(np.int64))
    return np.stack(out, 1)


def same_shape(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether invariants packed as LONGs agree."""
    a, b = [np.ascontiguousarray(x, np.int64).view("<i2").reshape(*x.shape, 4).astype(np.int32) for x in (a, b)]
    off = np.abs(a - b)
    round_ = int(2 * np.pi * TURN)
    turned = np.minimum(off[..., :2], round_ - off[..., :2])
    return (turned <= TURNED * TURN).all(axis=-1) & (off[..., 2] <= LONGER * 1000)


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many matched corners of two pictures agree on one shift, turn and scale."""
    if not len(a) or not len(b):
        return 0
    wa, wb = [np.ascontiguousarray(c["bits"]).view("<u8") for c in (a, b)]
    far = sum(np.bitwise_count(wa[:, None, k] ^ wb[None, :, k]).astype(np.uint8) for k in range(wa.shape[1]))
    i, j = np.nonzero((far <= FAR) & (far == far.min(axis=1, keepdims=True)) & (far == far.min(axis=0, keepdims=True)))
    n, best = len(i), 0
    if n < INLIERS:
        return 0
    za, zb = places(a)[i], places(b)[j]
    # two matches give a transform: turn and scale from their difference, near what the first one's own direction and level say;
    # each match goes with up to 24 others
    turn, scale = (b["angle"][j].astype(float) - a["angle"][i]) / TURN, np.log(np.array(LEVELS)[a["level"][i]] / np.array(LEVELS)[b["level"][j]])
    steps = np.unique(np.linspace(1, n - 1, min(n - 1, 24)).astype(int))
    first = np.repeat(np.arange(n), len(steps))
    second = (first + np.tile(steps, n)) % n
    d = za[second] - za[first]
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (zb[second] - zb[first]) / d
        fine = (np.abs(d) > 8) & (np.abs(np.log(np.abs(m)) - scale[first]) <= LONGER) & (np.abs(np.angle(m * np.exp(-1j * turn[first]))) <= TURNED)
    first, m = first[fine], m[fine]
    for k in range(0, len(m), step := max(1, 200_000 // n)):
        f, t = first[k : k + step], m[k : k + step]
        near = np.abs(zb[f][:, None] + t[:, None] * (za[None, :] - za[f][:, None]) - zb[None, :]) <= SLACK
        for row in near[near.sum(axis=1) > best]:
            best = max(best, min(len(np.unique(za[row])), len(np.unique(zb[row]))))
    return best


def features(images: DataFrame) -> DataFrame:
    """image_id, cid (of the content; null for null content) and corners (bytes) of images; a file that cannot be read has no corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                content = part["content"].to_pylist()
                shapes: dict[tuple, list[int]] = {}
                found = [decode(x) for x in content]
                for i, p in enumerate(found):
                    if p is not None:
                        shapes.setdefault(p.shape, []).append(i)
                out = [b""] * len(found)
                for shape, own in shapes.items():
                    step = max(1, (1 << 20) // (shape[0] * shape[1]))
                    for k in range(0, len(own), step):
                        for i, rows in zip(own[k : k + step], corners(np.stack([found[i] for i in own[k : k + step]]))):
                            out[i] = rows.tobytes()
                cids = [None if x is None else struct.unpack_from("<q", hashlib.sha256(x).digest())[0] for x in content]
                yield pa.RecordBatch.from_arrays([part["image_id"], pa.array(cids, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "cid", "corners"])

    return images.select(F.col("image_id").cast("long"), "content").mapInArrow(run, "image_id long, cid long, corners binary")


def entries(found: DataFrame, tests: np.ndarray) -> DataFrame:
    """key, cid and shape (invariants) of each pair of corners in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for cid, raw in zip(part["cid"].to_pylist(), part["corners"].to_pylist()):
                    c = np.frombuffer(raw, CORNER)
                    pairs = partners(c)
                    if len(pairs):
                        shape = np.zeros((len(pairs), 4), np.int16)
                        shape[:, :3] = invariants(c, pairs)
                        k = keys(c, pairs, tests)
                        out.append((k.ravel(), np.full(k.size, cid), np.repeat(shape.view(np.int64)[:, 0], k.shape[1])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "cid", "shape"])

    return found.mapInArrow(run, "key long, cid long, shape long")


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of pictures that are copies by their whole corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [agree(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) >= INLIERS for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(found.select(F.col("cid").alias("a"), F.col("corners").alias("x")), "a")
    return left.join(found.select(F.col("cid").alias("b"), F.col("corners").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def stars(crowd: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the smallest picture of each crowded entry, by its smallest shape, and others of the entry; ``crowd`` has key, cid and shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(same_shape(batch["centre"].to_numpy(), batch["shape"].to_numpy())))

    least = crowd.groupBy("key").agg(F.min(F.struct("cid", "shape")).alias("s")).select("key", F.col("s.cid").alias("a"), F.col("s.shape").alias("centre"))
    both = crowd.join(least, "key").where("cid <> a").select("a", F.col("cid").alias("b"), "centre", "shape")
    return both.mapInArrow(run, "a long, b long").distinct()


def crowded_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs of pictures of different components within crowded entries; ``members`` has key, cid, root and shape."""
    import pandas as pd

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cid, root, own, shape = [part[c].to_numpy() for c in ("cid", "root", "own", "shape")]
        left, right = np.nonzero(own == key[1])[0], np.nonzero(own == key[2])[0]
        out = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(left), 64):
            i = left[k : k + 64]
            near = (root[i][:, None] != root[right][None, :]) & same_shape(np.repeat(shape[i][:, None], len(right), 1), np.repeat(shape[right][None, :], len(i), 0))
            a, b = np.nonzero(near)
            out.append(np.sort(np.stack([cid[i[a]], cid[right[b]]], 1), axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    dealt = tables.in_blocks(members, F.ceil(F.count("*") / BLOCK))
    return dealt.groupBy("key", "x", "y").applyInPandas(run, "a long, b long").distinct()


def copies(images: DataFrame, scratch: Scratch, expected: int = EXPECTED) -> DataFrame:
    """image_id, n_equal, component_id and kept of every row of ``images`` (image_id, content).

    n_equal is the number of other rows with the same file; component_id is the smallest image_id
    joined by links, which are equal files and pictures found to be copies of one another; kept says
    whether it is the row's own. Null, empty and unreadable files, and pictures too small or too
    plain for corners, link with their equals only; null content links with nothing. Repeated
    image_ids give a row each; a null image_id is a component_id only where no other is, and is
    never kept. An empty table gives no rows; other columns are left out.

    ``expected`` is the number of pictures that tables are laid out for: with many more, chance
    meetings, which grow with the square of the pictures, take ever more of the time. Other
    pictures of ``images`` do not change whether two are linked.
    """
    rows = scratch.write(features(images), "features")
    firsts = rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("n"), F.min("image_id").alias("first"), F.first("corners").alias("corners"))
    distinct = scratch.write(firsts, "distinct")
    found = distinct.select("cid", "corners").where(F.octet_length("corners") > 0)
    tests = chosen_tests(*tables_for(expected))
    sample = entries(found.sample(False, tables.SAMPLE, 1), tests)
    met = scratch.write(tables.meet(entries(found, tests), sample, ["shape"], lambda x, y: same_shape(x[0], y[0]), CROWD), "meet")
    edges = verified(met.where("b is not null").select("a", "b").distinct(), found)
    crowd = met.where("key is not null").select("key", F.col("a").alias("cid"), "shape")
    crowded = not crowd.isEmpty()
    edges = scratch.write(edges.union(verified(stars(crowd), found)) if crowded else edges, "edges")
    roots = components(edges, scratch)
    if crowded:
        more = verified(crowded_pairs(scratch.write(tables.apart(crowd, roots), "apart")), found)
        roots = components(edges.union(scratch.write(more, "more")), scratch, "cc-more")
    roots = roots.select(F.col("node").alias("cid"), "root")
    own = scratch.write(distinct.select("cid", "n", "first").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "own")
    least = scratch.write(own.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_cid = scratch.write(own.join(least, "root").select("cid", (F.col("n") - 1).alias("n_equal"), "component_id"), "by-cid")
    out = rows.select("image_id", "cid").join(by_cid, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("image_id")).otherwise(F.col("component_id"))
    return out.select("image_id", F.coalesce("n_equal", F.lit(0)).alias("n_equal"), component.alias("component_id"), F.coalesce(F.col("image_id") == component, F.lit(False)).alias("kept"))


def picture(vector: np.ndarray, side: int = 96) -> np.ndarray:
    """A picture made of a vector: its bytes seed coarse and fine clouds and a few plain shapes."""
    rng = np.random.default_rng(zlib.crc32(vector.tobytes()))
    out = np.full((side, side), 128.0, np.float32)
    for cells, depth in ((side // 8, 50), (side // 4, 45), (side * 2 // 5, 35)):
        clouds = rng.normal(0, depth, (1, cells, cells)).astype(np.float32)
        out += resize(clouds, side / cells)[0]
    for _ in range(4):
        x, y, w, h = *rng.integers(0, side - 12, 2), *rng.integers(8, side // 4, 2)
        out[y : y + h, x : x + w] = rng.integers(0, 256)
    return out


def edited(p: np.ndarray, kind: int) -> np.ndarray:
    """One of KINDS edits: a crop to three quarters, a change of brightness and contrast, two smaller sizes, a quarter turn, a crop to half."""
    h, w = p.shape
    smaller = lambda scale: resize(p[None].astype(np.float32), scale)[0]
    return (p[h // 10 :, w // 16 : -(w // 12)], p * 0.7 + 40, smaller(0.8), np.rot90(p), p[h // 7 : -(h // 7), w // 7 : -(w // 7)], smaller(0.65))[kind % KINDS]


def pictures(vectors: DataFrame, every: int = 20) -> DataFrame:
    """Test pictures of a table of vectors: image_id 2 * vec_id, and where vec_id is divisible by ``every`` an edited copy 2 * vec_id + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for i, v in zip(part["vec_id"].to_pylist(), part["embedding"].to_pylist()):
                    if i is None:
                        continue
                    p = picture(np.nan_to_num(np.array([x or 0 for x in v or []], np.float32)))
                    rows.append((2 * i, encode_pgm(p)))
                    if i % every == 0:
                        rows.append((2 * i + 1, encode_pgm(edited(p, i // every))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["image_id", "content"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "image_id long, content binary")

"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and runs of white space become one space. The features are which hashed
n-grams of UTF-8 bytes, of LENGTHS, a text has. Each is scaled by the logarithm of how much more
often it is in toxic than in other training texts, and logistic regression weighs the scaled
features. Only n-grams significantly more frequent in toxic texts are used (at least LEAST_Z standard
errors, the FEATURES most significant): ordinary words must not outweigh an insult.

Training takes at most SAMPLE labelled rows of each class, those with the smallest hash of doc_id;
that bound is what keeps the model's tables and the fit on the driver small. Scoring reads every
whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch

LENGTHS = (3, 4, 5, 6)
#: Hashed n-grams are numbers below 2**WIDTH.
WIDTH = 20
FEATURES = 8192
LEAST_Z = 4.5
#: Most training rows of each class.
SAMPLE = 6000
THRESHOLD = 0.7
ROUNDS = 200
PENALTY = 10.0
#: Rows that a training step goes through at once.
CHUNK = 1000
#: Bytes hashed at once; longer texts go piece by piece, overlapping by the longest n-gram.
PIECE = 1 << 16


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, one array a length and piece, repeats included."""
    data = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode(), np.uint8)
    over = max(LENGTHS) - 1
    for at in range(0, max(len(data) - over, 1), PIECE):
        piece = data[at : at + PIECE + over].astype(np.uint32)
        last = at + PIECE + over >= len(data)
        h = piece
        for n in range(2, max(LENGTHS) + 1):
            if n > len(piece):
                return
            h = h[:-1] * np.uint32(0x01000193) + piece[n - 1 :]
            if n in LENGTHS:
                x = h if last else h[:PIECE]
                x = (x ^ (x >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield x >> np.uint32(32 - WIDTH)


@dataclass
class Model:
    """``place`` maps an n-gram to its feature, or to the last weight, which is 0."""

    place: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        seen = np.zeros(len(self.weights), bool)
        for h in ngrams(text):
            seen[self.place[h]] = True
        return float(1 / (1 + np.exp(-(self.weights[seen].sum() + self.intercept))))


def document_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In how many texts of each class an n-gram is: toxic, other, and the numbers of texts.

    A task sends two arrays of fixed size, and more only beyond 65,535 rows of a class; the sample has
    at most 2 * SAMPLE rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"n0": [n[0]], "n1": [n[1]], "c": [found.tobytes()]})

        found, n = np.zeros((2, 1 << WIDTH), np.uint16), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                hashes = list(ngrams(text))
                one = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint32)
                found[toxic][one] += 1
                n[toxic] += 1
                if n[toxic] == 65535:
                    yield rows()
                    found, n = np.zeros_like(found), [0, 0]
        if sum(n):
            yield rows()

    total, n = np.zeros((2, 1 << WIDTH), np.int32), np.zeros(2, np.int64)
    for row in sample.mapInArrow(run, "n0 long, n1 long, c binary").toLocalIterator():
        total += np.frombuffer(row["c"], np.uint16).reshape(2, -1)
        n += [row["n0"], row["n1"]]
    return total[1], total[0], n


def logistic(lists: list[np.ndarray], scale: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by adaptive gradient steps, both classes weighing the same.

    ``lists`` holds each row's features: a step goes through CHUNK rows at once.
    """
    n, w, b = len(labels), np.zeros(len(scale)), 0.0
    each = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    gw, gb = np.full(len(scale), 1e-8), 1e-8
    parts = [(k, np.concatenate(lists[k : k + CHUNK]), np.repeat(np.arange(len(lists[k : k + CHUNK]), dtype=np.int32), [len(x) for x in lists[k : k + CHUNK]])) for k in range(0, n, CHUNK)]
    for _ in range(ROUNDS):
        ws, g, total = w * scale, np.zeros(len(scale)), 0.0
        for k, features, rows in parts:
            m = min(CHUNK, n - k)
            s = np.bincount(rows, weights=ws[features], minlength=m) + b
            e = (1 / (1 + np.exp(-s)) - labels[k : k + m]) * each[k : k + m]
            g += np.bincount(features, weights=e[rows], minlength=len(scale))
            total += e.sum()
        g = g * scale + w * PENALTY / n
        gw += g * g
        w -= 0.1 * g / np.sqrt(gw)
        gb += total * total
        b -= 0.1 * total / np.sqrt(gb)
    return w, b


def train(labelled: DataFrame, docs: DataFrame, scratch: Scratch, most: int = SAMPLE) -> Model:
    """Fit on ``labelled`` (doc_id, toxic 0 or 1; null labels are left out) and the texts of ``docs``.

    At most ``most`` rows of each class, by hash of doc_id. A doc_id labelled both ways counts as
    toxic; of documents that repeat a doc_id the one with the smallest text hash trains, and a null
    doc_id none. Without one of the classes, or without any text, every score is the share of toxic
    rows (0 if there are none).
    """
    ids, marked = None, labelled.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    for toxic in (0, 1):
        part = marked.where(F.col("toxic") == toxic).select("doc_id", F.lit(toxic).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.union(part)
    ids = scratch.write(ids, "sample-ids")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * most rows
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("toxic").alias("toxic")).select("doc_id", "t.text", "toxic")
    sample = scratch.write(sample.repartition(12, "doc_id"), "sample")
    toxic, other, n = document_counts(sample)
    place = np.full(1 << WIDTH, FEATURES, np.uint16)
    if not n.all():
        return Model(place, np.zeros(FEATURES + 1), 50.0 if n[1] else -50.0)
    often = np.nonzero(toxic + other > 1)[0]
    toxic, other = toxic[often], other[often]
    share = (toxic + other) / n.sum()
    z = (toxic / n[1] - other / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    best = np.argsort(-z, kind="stable")[:FEATURES]
    best = best[z[best] >= min(LEAST_Z, z[best[:256]].min(initial=LEAST_Z))]  # from few texts nothing may be that significant
    chosen = often[best]
    place[chosen] = np.arange(len(chosen))
    scale = np.log((toxic[best] + 1) / (n[1] + 2)) - np.log((other[best] + 1) / (n[0] + 2))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                seen = np.zeros(FEATURES + 1, bool)
                for h in ngrams(text):
                    seen[place[h]] = True
                out.append(np.nonzero(seen[:-1])[0].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(out, pa.binary())], names=["toxic", "f"])

    got = sample.mapInArrow(features, "toxic int, f binary").collect()  # at most 2 * most rows of FEATURES bits
    lists = [np.frombuffer(r["f"], np.uint16) for r in got]
    w, b = logistic(lists, scale, np.array([r["toxic"] for r in got]))
    return Model(place, np.append(w * scale, np.zeros(FEATURES + 1 - len(scale))), float(b))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` of 0 to 1.

    Null and empty texts are scored like any other, and alike; repeated rows get the same score
    each; a column that has the name already is replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.place, model.weights, model.intercept))

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        own = Model(*shared.value)
        return pd.Series([own.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, run("text"))

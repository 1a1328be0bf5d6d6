"""Toxicity scores: logistic regression fitted with FTRL-proximal on hashed word features.

Features are the distinct hashed words, bigrams, trigrams and skip-bigrams (one
word left out) of a text. FTRL keeps a rate per coordinate, and its L1 term
leaves all but a few weights at exactly zero: the weights that remain are a
small table, bounded by the number of hash slots.

* Null, empty and wordless texts have no features; their score is that of the bias.
* Texts are read whole, whatever their length. Equal texts have equal scores.
* A label that is null is no label; several labels of one id count as their maximum.
* Without any usable label every score is the neutral prior below one half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm.common import LETTERS, utf8

SLOTS = 1 << 20
FOLDS = 5
# The classifier is fitted on at most this many labelled documents, the first by hash of the id.
SAMPLE = 12_000
PASSES = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
# Weight of a toxic row, which are the few.
POSITIVE = 4.0
# Words whose hash a worker remembers.
REMEMBER = 1 << 18
# Words of a text that are turned into features at a time.
BLOCK = 1 << 17

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


_words = _Words()


def features(text: bytes, slots: int = SLOTS) -> np.ndarray:
    """Distinct feature slots of one UTF-8 text, ascending."""
    words = text.translate(LETTERS).split()
    parts = [np.empty(0, np.uint32)]
    for at in range(0, len(words), BLOCK):
        block = words[at:at + BLOCK + 2]
        h = np.fromiter(map(_words.__getitem__, block), np.uint64, len(block))
        a, b = h * _MIX[0], h * _MIX[1]
        one = h[:BLOCK]
        two = (a[:-1] ^ b[1:])[:BLOCK]
        skip = (a[:-2] ^ (b[2:] * _MIX[2]))[:BLOCK]
        three = (a[:-2] ^ b[1:-1] ^ (h[2:] * _MIX[3]))[:BLOCK]
        mixed = np.concatenate([one, two, skip, three]) * _MIX[0]
        parts.append(np.unique((mixed >> np.uint64(40)).astype(np.uint32) % np.uint32(slots)))
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    """Bias and the non-zero weights by slot."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    size: int = SLOTS

    def dense(self) -> np.ndarray:
        full = np.zeros(self.size)
        full[self.slots] = self.weights
        return full


def fit(rows: list[np.ndarray], labels: list[int], slots: int = SLOTS, passes: int = PASSES) -> Model:
    """FTRL-proximal over the rows in order, ``passes`` times. The bias has no L1 term."""
    z, n = np.zeros(slots), np.zeros(slots)
    bz = bn = 0.0

    def weights(z, n, l1):
        shrunk = np.where(np.abs(z) <= l1, 0.0, np.sign(z) * l1 - z)
        return shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(passes):
        for at, label in zip(rows, labels):
            zi, ni = z[at], n[at]
            w, b = weights(zi, ni, L1), float(weights(np.float64(bz), np.float64(bn), 0.0))
            error = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label) * (POSITIVE if label else 1.0)
            square = error * error
            z[at] = zi + error - (np.sqrt(ni + square) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + square
            bz += error - (np.sqrt(bn + square) - np.sqrt(bn)) / ALPHA * b
            bn += square
    w = weights(z, n, L1)
    kept = np.flatnonzero(w)
    return Model(float(weights(np.float64(bz), np.float64(bn), 0.0)), kept, w[kept], slots)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, slots) of the labelled documents outside the held-out fold, at most ``sample``."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("label")).where(fold(F.col("doc_id")) != 0)
    # At most ``sample`` narrow rows: safe to broadcast.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).view(np.int32) for t in texts], pa.list_(pa.int32()))

    slots = F.arrow_udf(extract, "array<int>")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "label", slots(utf8()).alias("slots"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    got = training_rows(docs, labels, sample).toArrow()
    ids, label = got["doc_id"].to_pylist(), got["label"].to_pylist()
    rows = [np.asarray(s.values) for s in got["slots"]]
    # An order that depends on neither files nor partitions.
    order = sorted(range(len(ids)), key=lambda i: (xxh64_intdigest(str(ids[i])), rows[i].tobytes()))
    if not order:
        return Model(-1.0, np.empty(0, np.int64), np.empty(0))
    return fit([rows[i] for i in order], [int(label[i] > 0) for i in order])


def scorer(model: Model):
    """Column function: UTF-8 text to its score."""
    held = {}

    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held["w"] = model.dense()
        w = held["w"]
        raw = np.array([w[features(t.as_py(), model.size)].sum() for t in texts], float) + model.bias
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))), pa.float64())

    return F.arrow_udf(score, "double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(utf8()).alias("score"))
    return rows.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a score under one half, with all their columns."""
    return docs.where(scorer(train(docs, labels))(utf8()) < 0.5)

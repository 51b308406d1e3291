"""Hashed word, character and word-shape n-grams, and bounded training samples of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.textkernel import LOWER, U64, Words, chunks, mix
from girder.scratch import Scratch

BITS = 16
SIZE = 1 << BITS
FAMILIES = 3  # characters, words, shapes

#: Byte classes whose presence makes up a word's shape: lower, upper, digit, non-ASCII, sentence marks, other marks.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 8
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 16
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0

#: (feature indices, first and end index of each row) of one family.
Family = tuple[np.ndarray, np.ndarray, np.ndarray]


def families(data: np.ndarray, offsets: np.ndarray) -> list[Family]:
    """Feature indices of a chunk: 4-byte grams, words and word pairs, shapes and shape pairs."""
    folded = LOWER[data].astype(np.uint32)
    grams = np.zeros(len(data), np.uint32)
    if len(data) >= 4:
        grams[:-3] = folded[:-3] | folded[1:-2] << 8 | folded[2:-1] << 16 | folded[3:] << 24
    chars = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    first, end = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - 3)

    words = Words(data, offsets, LOWER)
    n = len(words.hashes)
    same = np.zeros(n, U64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    heads = words.rows[:-1][words.rows[:-1] < words.rows[1:]]
    same[heads] = 0
    kinds = np.bitwise_or.reduceat(_CLASS[data], words.starts).astype(U64) if n else np.zeros(0, U64)
    length = np.minimum(words.ends - words.starts, 16).astype(U64) >> U64(1)
    shape = mix(kinds | same << U64(8) | length << U64(9))

    def with_pairs(x: np.ndarray) -> np.ndarray:
        """Each value followed by its pair with the value before; a row's first value pairs with 0."""
        before = np.zeros(n, U64)
        before[1:] = x[:-1]
        before[heads] = 0
        out = np.empty(2 * n, np.int64)
        out[0::2] = x >> U64(64 - BITS)
        out[1::2] = mix(x + before * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)
        return out

    rows = words.rows * 2
    return [
        (chars.astype(np.int64), first, end),
        (with_pairs(words.hashes), rows[:-1], rows[1:]),
        (with_pairs(shape), rows[:-1], rows[1:]),
    ]


def family_scores(found: list[Family], weights: np.ndarray, bias: float) -> np.ndarray:
    """bias plus, for each family, the mean weight of the row's features."""
    out = np.full(len(found[0][1]), bias)
    for k, (index, first, end) in enumerate(found):
        sums = np.zeros(len(index) + 1)
        np.cumsum(weights[k * SIZE + index], out=sums[1:])
        out += (sums[end] - sums[first]) / np.maximum(1, end - first)
    return out


def linear_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return family_scores(families(data, offsets), weights, bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def row_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, relative frequencies) of every row."""
    found = families(data, offsets)
    for row in range(len(offsets) - 1):
        index, value = [], []
        for k, (ids, first, end) in enumerate(found):
            u, count = np.unique(ids[first[row] : end[row]], return_counts=True)
            index.append(u + k * SIZE)
            value.append(count / max(1, end[row] - first[row]))
        yield np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


def sparse_rows(used: np.ndarray):
    """A function for mapInArrow: (doc_id, text, label) to (doc_id, label, index, value) of the ``used`` features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                index, value = [], []
                for i, v in row_features(data, offsets):
                    keep = used[i]
                    index.append(i[keep].tobytes())
                    value.append(v[keep].tobytes())
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "label", "index", "value"])

    return run


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text modulo ``by``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(-1)).cast("int")


def labelled_ids(labels: DataFrame, label: str, allowed: Column, per_class: int, classes: Sequence[int] = (0, 1)) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most ``per_class`` allowed rows per class, and the count of all allowed rows per class.

    The choice follows a hash of the id, so it is the same at every partitioning. Repeated ids take their
    largest label; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*classes) & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {int(k): n for k, n in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in classes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, counts


def take(documents: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, label, text) of the documents in ``ids`` (doc_id, label), which has a proven size bound.

    One row for each id: of repeated documents the least text counts.
    """
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return scratch.save(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")


def count_features(sample: DataFrame, features: Callable, size: int, least: Column) -> pa.Table:
    """(index, n0, n1): how many rows labelled 0 and 1 have a feature, where ``least`` holds for these numbers.

    ``features`` gives the distinct feature indices of every row of a chunk. Tasks count what they read, so the driver gets
    one row for each feature, whatever the texts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for row, _, data, offsets in chunks(batch.column("text")):
                for k, index in enumerate(features(data, offsets)):
                    total[labels[row + k], index] += 1
        index = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(index), *[pa.array(t[index]) for t in total]], names=["index", "n0", "n1"])

    made = sample.select("label", "text").mapInArrow(run, "index long, n0 long, n1 long")
    return made.groupBy("index").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(least).toArrow()


def gather(documents: DataFrame, ids: DataFrame, least_share: float = 0.01) -> list:
    """(doc_id, label, index, value) of the documents in ``ids``, with the features that ``least_share`` of them have."""
    scratch = Scratch(documents.sparkSession, "sample")
    sample = take(documents, ids, scratch)
    least = max(2, least_share * sample.count())
    found = count_features(sample, lambda data, offsets: (i for i, _ in row_features(data, offsets)), FAMILIES * SIZE, F.col("n0") + F.col("n1") >= least)
    used = np.zeros(FAMILIES * SIZE, bool)
    used[found["index"].to_numpy()] = True
    made = sample.mapInArrow(sparse_rows(used), "doc_id long, label int, index binary, value binary").orderBy("doc_id").collect()
    scratch.drop("sample")
    return made


class Sparse:
    """Rows of a training sample, scaled to unit root mean square.

    The bytes of a row are let go as it is read: ``rows`` is empty afterwards.
    """

    def __init__(self, rows: list):
        self.n = len(rows)
        self.lengths = np.array([len(r["index"]) // 4 for r in rows], np.int64)
        self.col, self.val = np.zeros(self.lengths.sum(), np.int64), np.zeros(self.lengths.sum())
        used = np.zeros(FAMILIES * SIZE, bool)
        at = 0
        for k, n in enumerate(self.lengths.tolist()):
            self.col[at : at + n] = np.frombuffer(rows[k]["index"], np.int32)
            self.val[at : at + n] = np.frombuffer(rows[k]["value"], np.float32)
            used[self.col[at : at + n]] = True
            rows[k] = None
            at += n
        rows.clear()
        self.names = np.flatnonzero(used)
        self.size = len(self.names)
        self.col = (np.cumsum(used) - 1)[self.col]
        self.ends = np.cumsum(self.lengths)
        power = np.bincount(self.col, self.val * self.val, self.size) / max(1, self.n)
        self.scale = 1 / np.sqrt(power + 1e-5)
        self.val *= self.scale[self.col]

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.val) + 1)
        np.cumsum(self.val * w[self.col], out=sums[1:])
        return sums[self.ends] - sums[self.ends - self.lengths]

    def back(self, r: np.ndarray) -> np.ndarray:
        each = np.repeat(r, self.lengths)
        each *= self.val
        return np.bincount(self.col, each, self.size)

    def curvature(self, weight: np.ndarray) -> float:
        """Largest eigenvalue of the second moments under row weights, by power iteration."""
        v = np.ones(self.size) / max(1.0, self.size) ** 0.5
        top = 1.0
        for _ in range(12):
            v = self.back(weight * self.dot(v))
            top = float(np.linalg.norm(v)) or 1.0
            v /= top
        return top

    def unscaled(self, w: np.ndarray) -> np.ndarray:
        """Weights of all features for raw frequencies."""
        out = np.zeros(FAMILIES * SIZE)
        out[self.names] = w * self.scale
        return out


def descend(gradient: Callable[[np.ndarray, float], tuple[np.ndarray, float]], size: int, curvature: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Minimise by accelerated gradient steps of 1 / curvature from zero, so strong features move first."""
    w, b, lead, lead_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for t in range(steps):
        g, gb = gradient(lead, lead_b)
        new, new_b = lead - g / curvature, lead_b - gb / curvature
        pull = t / (t + 3)
        lead, lead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, b


def adam(gradient: Callable[[np.ndarray, float], tuple[np.ndarray, float]], size: int, steps: int = 120, rate: float = 0.02, floor: float = -np.inf) -> tuple[np.ndarray, float]:
    """Minimise by Adam from zero; ``gradient`` gives the gradients of weights and bias. Weights stay at ``floor`` or above."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(w, b)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        if floor > -np.inf:
            np.maximum(w, floor, out=w)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return w, b

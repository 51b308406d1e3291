"""Quality rules: counted base rules, then a calibrated logistic model over hashed n-grams.

The base statistics of a text follow from one vectorised pass over its bytes. The model is a logistic
regression over hashed word, character and word-shape n-grams, fitted on at most ``per_class`` labelled rows
a class (chosen by a hash of the id) and Platt-calibrated on a fifth of them, weighted to the class counts of
all labelled rows. A text is kept if it passes the base rules and its probability reaches ``threshold``.

Defined cases: null text counts as empty (all statistics 0, base_failed true); without labels of both classes
the model accepts everything; repeated rows are judged alike; other columns of the input are ignored; an
empty table gives an empty result. Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.features import FAMILIES, SIZE, Sparse, descend, gather, labelled_ids, sigmoid
from girder.llm.quality_classifier import Linear
from girder.llm.textkernel import SPACE, U64, Words, chunks, mix, ranges_hash, row_sums, tidy, windows_hash

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, score double, kept boolean"


def in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """64-bit keys of (row, value)."""
    return values ^ mix(row.astype(U64) + U64(1))


def distinct_per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct values of each row."""
    _, first = np.unique(in_row(values, row), return_index=True)
    return np.bincount(row[first], minlength=rows)


def base_stats(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The five counts of every row of a chunk."""
    rows = len(offsets) - 1
    words = Words(data, offsets)
    n_words = np.diff(words.rows)

    wide = windows_hash(words.hashes, window)
    row = np.repeat(np.arange(rows), n_words)
    whole = np.flatnonzero(row[: len(wide)] == row[window - 1 :]) if len(wide) else np.zeros(0, np.int64)
    keys = in_row(wide[whole], row[whole])
    at = np.argsort(keys)
    order, keys = whole[at], keys[at]
    same = keys[1:] == keys[:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    size = len(words.hashes) + 1
    steps = np.bincount(order[again], minlength=size) - np.bincount(order[again] + window, minlength=size)
    covered = np.cumsum(steps[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    starts.sort()
    ends.sort()
    line_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    line_row.sort()
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=inside[1:])
    full = inside[ends] > inside[starts]
    lines = ranges_hash(data, starts[full], ends[full])
    n_lines = np.bincount(line_row[full], minlength=rows)
    return {
        "n_words": n_words,
        "word_chars": row_sums(words.part & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": n_lines - distinct_per_row(lines, line_row[full], rows),
        "n_repeat_words": row_sums(covered, words.rows),
    }


def fit_calibrated(rows: list, counts: dict[int, int], decay: float = 1e-4) -> Linear:
    """Logistic regression on four fifths of the rows, Platt scaling on the rest."""
    label = np.array([r["label"] for r in rows], float)
    size = FAMILIES * SIZE
    if not (label == 1).any() or not (label == 0).any():
        return Linear(np.zeros(size), 30.0)
    x = Sparse(rows)
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    spare = np.arange(len(label)) % 5 == 4
    if len(set(label[spare])) < 2:
        spare[:] = True
    train = np.ones(len(label), bool) if spare.all() else ~spare

    def logistic(w, b):
        r = weight * train * (sigmoid(x.dot(w) + b) - label)
        return x.back(r) + decay * w, r.sum()

    w, b = descend(logistic, x.size, 0.25 * x.curvature(weight) + decay)
    z, y = (x.dot(w) + b)[spare], label[spare]
    total = {c: counts.get(c, 0) / max(1, (label == c).sum()) for c in (0, 1)}
    share = np.where(y == 1, total[1], total[0])
    goal = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps on two parameters, lightly damped
        p = sigmoid(slope * z + shift)
        r, h = share * (p - goal), share * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[h @ (z * z), h @ z], [h @ z, h.sum()]]) + 1e-3 * share.sum() * np.eye(2)
        step = np.linalg.solve(hessian, [r @ z, r.sum()])
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return Linear(x.unscaled(w), b, max(slope, 1e-3), shift)


def judge(model: Linear, threshold: float, least_words: int, most_repeated_percent: int):
    """A function for mapInArrow: (doc_id, text) to the columns of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                stats = base_stats(data, offsets)
                failed = (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > most_repeated_percent * stats["n_words"])
                score = model.probabilities(data, offsets)
                columns = [pa.array(stats[c].astype(np.int64)) for c in STATS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), *columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                    names=["doc_id", *STATS, "base_failed", "score", "kept"],
                )

    return run


def apply_quality_rules(
    documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, threshold: float = 0.5, least_words: int = 10, most_repeated_percent: int = 20
) -> DataFrame:
    """Statistics, base verdict, calibrated probability and final verdict of every document."""
    ids, counts = labelled_ids(labels, label, F.lit(True), per_class)
    model = fit_calibrated(gather(documents, ids), counts)
    return documents.select("doc_id", "text").mapInArrow(tidy(judge(model, threshold, least_words, most_repeated_percent)), SCHEMA)


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, threshold: float = 0.5, least_words: int = 10, most_repeated_percent: int = 20) -> DataFrame:
    """The documents that the rules keep, with all their columns; rows are judged where they are."""
    ids, counts = labelled_ids(labels, label, F.lit(True), per_class)
    run = judge(fit_calibrated(gather(documents, ids), counts), threshold, least_words, most_repeated_percent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [part.column("kept") for part in run(iter([batch]))]
            yield batch.filter(pa.chunked_array(verdicts, pa.bool_()).combine_chunks())

    return documents.mapInArrow(tidy(keep), documents.schema)

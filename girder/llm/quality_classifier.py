"""Quality classifier by positive-unlabelled learning.

Trusted positives are the allowed rows labelled 1; unlabelled text is web text without labels. The
class prior is estimated by best-bin estimation: a first model separates positives from unlabelled text,
and the prior is the least ratio of unlabelled to positive mass above a threshold, with a margin for
sampling error. It is estimated twice, by models of either half of the fitted rows on what they have not seen, and
averaged. The unlabelled mass is that of all documents without labels but those that the model was
fitted on: they are scored where they are, by both models in one pass, and counted in BINS bins of the score. The final linear
model over hashed n-grams minimises the non-negative unbiased risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` of the sigmoid loss; the first models' loss is logistic.

Bounds: at most ``most_positive`` rows labelled 1 and ``most_unlabelled`` unlabelled ones are fitted, chosen by a hash of the
id, so the risk of the final model takes R_U from a sample; the prior does not. Every document is scored, whole. Unlabelled
means that no row of the labels names the document; of held-out rows nothing but the id is read.

Defined cases: null text scores as empty text; without positives or unlabelled text every score is 0.5;
repeated rows score alike; a null doc_id is never learned from and is not held out; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.features import FAMILIES, SIZE, Sparse, descend, families, family_scores, gather, labelled_ids, linear_scores, sigmoid
from girder.llm.textkernel import chunks, tidy

BINS = 1 << 13
HIGHEST = 30.0  # of a score, before the sigmoid


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * linear_scores(data, offsets, self.weights, self.bias) + self.shift)


def score_bins(z: np.ndarray) -> np.ndarray:
    return np.clip((z + HIGHEST) * (BINS / (2 * HIGHEST)), 0, BINS - 1).astype(np.int32)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, counts: np.ndarray | None = None) -> float:
    """Best-bin estimate of the share of positives in the unlabelled scores, which ``counts`` may give the numbers of."""
    counts = np.ones(len(unlabelled), np.int64) if counts is None else counts
    order = np.argsort(unlabelled)
    below = np.concatenate([[0], np.cumsum(counts[order])])
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - below[np.searchsorted(unlabelled[order], cuts)] / below[-1]
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(below[-1]))
    at = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[at] / max(p[at], 1e-9), 0.01, 0.99))


def fit_pu(rows: list, count_unlabelled: Callable[[list[Linear], list[list]], list[list]], decay: float = 1e-4) -> tuple[Linear, float]:
    """Model and prior from rows labelled 1 (trusted positive) and 0 (unlabelled).

    ``count_unlabelled`` takes the first models and for each the ids of the unlabelled rows that it has seen, and returns for
    each (bin, count) of the scores of all others.
    """
    label = np.array([r["label"] for r in rows])
    size = FAMILIES * SIZE
    if not (label == 1).any() or not (label == 0).any():
        return Linear(np.zeros(size), 0.0), 0.5
    ids = np.array([r["doc_id"] for r in rows])
    x = Sparse(rows)
    share = label.mean()
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(label)
    models, margins, seen = [], [], []
    turn = np.arange(len(label)) % 2
    for fold in (0, 1):
        own = turn == fold
        if len(set(label[own])) < 2:  # too few rows for halves
            own = np.ones(len(label), bool)

        def logistic(w, b, own=own):
            r = weight * own * (sigmoid(x.dot(w) + b) - label)
            return x.back(r) + decay * w, r.sum()

        w, b = descend(logistic, x.size, 0.25 * x.curvature(weight) + decay, 60)
        z = x.dot(w) + b
        held = ~own if (~own & (label == 1)).any() else own
        models.append(Linear(x.unscaled(w), b))
        margins.append((score_bins(z[held & (label == 1)]), score_bins(z[label == 0])))
        seen.append(ids[own & (label == 0)].tolist())
    found = []
    for (positive, unlabelled), counted in zip(margins, count_unlabelled(models, seen), strict=True):
        if counted:
            bins, counts = (np.array(c, np.int64) for c in zip(*counted, strict=True))
            found.append(estimate_prior(positive, bins, counts=counts))
        else:  # the model has seen all there is
            found.append(estimate_prior(positive, unlabelled))
    prior = float(np.mean(found))
    pos, unl = (label == 1) / max(1, (label == 1).sum()), (label == 0) / max(1, (label == 0).sum())

    def non_negative(w, b):
        s = sigmoid(x.dot(w) + b)
        steep = s * (1 - s)
        r = (unl - prior * pos) * steep
        if (unl - prior * pos) @ s >= 0:
            r -= prior * pos * steep
        else:
            r = -r
        return x.back(r) + decay * w, r.sum()

    w, b = descend(non_negative, x.size, 0.1 * x.curvature(np.abs(unl - prior * pos) + prior * pos) + decay)
    return Linear(x.unscaled(w), b), prior


def score_column(model: Linear):
    """A function for mapInArrow: (doc_id, held_out, text) to (doc_id, held_out, score)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, end, data, offsets in chunks(batch.column("text")):
                scores[row:end] = model.probabilities(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], names=["doc_id", "held_out", "score"])

    return score


def bin_columns(models: list[Linear]):
    """A function for mapInArrow: (doc_id, text) to (doc_id, bins) of each model's scores before the sigmoid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.zeros((batch.num_rows, len(models)), np.int32)
            for row, end, data, offsets in chunks(batch.column("text")):
                found = families(data, offsets)
                for k, model in enumerate(models):
                    bins[row:end, k] = score_bins(family_scores(found, model.weights, model.bias))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(models)), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "bins"])

    return run


def classify_quality(documents: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", most_positive: int = 1500, most_unlabelled: int = 1500) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``held_out`` is an expression on doc_id."""
    positives, _ = labelled_ids(labels, label, ~held_out, most_positive, (1,))
    known = labels.select("doc_id").distinct()
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull())
    free = ids.join(known, "doc_id", "left_anti").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_unlabelled)
    chosen = positives.unionByName(free.withColumn("label", F.lit(0)))

    def count_unlabelled(models: list[Linear], seen: list[list]) -> list[list]:
        """(bin, count) of all documents without labels that a model has not seen; of repeated documents the least bin counts."""
        met = documents.sparkSession.createDataFrame([(d, k) for k, own in enumerate(seen) for d in own], "doc_id long, model int")
        texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
        bins = texts.mapInArrow(tidy(bin_columns(models)), "doc_id long, bins array<int>").join(known, "doc_id", "left_anti")
        each = bins.select("doc_id", F.posexplode("bins").alias("model", "bin")).join(F.broadcast(met), ["doc_id", "model"], "left_anti")
        rows = each.groupBy("doc_id", "model").agg(F.min("bin").alias("bin")).groupBy("model", "bin").agg(F.count("*").alias("n")).collect()
        return [[(r["bin"], r["n"]) for r in rows if r["model"] == k] for k in range(len(models))]

    model, _ = fit_pu(gather(documents, chosen), count_unlabelled)
    scored = documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(tidy(score_column(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

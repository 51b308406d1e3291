"""Toxicity by multiple-instance learning: sentence scores under a noisy-or.

A document is toxic if at least one of its sentences is: ``P = 1 - prod(1 - p_s)`` with
``p_s = sigmoid(bias + sum of the weights of the sentence's words and of their beginnings)``. Only document labels are known; the
likelihood of the noisy-or passes them down to the sentences, and the sentence scores then locate what is
toxic. Words are runs of letters and digits (bytes from 0x80 count as letters) with A-Z folded; sentences end
at ``.``, ``!``, ``?`` or a line break.

Bounds: at most ``per_class`` labelled documents a class are fitted, chosen by a hash of the id and weighted
to the class counts of all allowed labels. Features are counted where the texts are; the driver gets only the sentences that
have a feature in use, and the number of the others, whose scores are all alike. Every document is fitted and scored whole.

Defined cases: null text and text without words score 0 and have no worst sentence; without labels of both classes every score is 0;
repeated rows score alike; a null doc_id is never learned from and is not held out; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.features import adam, count_features, labelled_ids, sigmoid, take
from girder.llm.textkernel import LOWER, U64, Words, chunks, ranges_hash, row_sums, tidy
from girder.scratch import Scratch

BITS = 19
PREFIXES = (4, 5, 6, 7, 8)  # bytes
FACTORS = 1 + len(PREFIXES)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(features of the words in turn, feature offset of each sentence, sentence offset of each row, words) of a chunk.

    A word has FACTORS features: itself and its beginnings; feature 0 stands for a beginning that the word is too short for.
    """
    words = Words(data, offsets, LOWER, _WORD)
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    number = stops[words.starts]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.rows))
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    index = np.zeros((len(number), FACTORS), np.int64)
    index[:, 0] = words.hashes >> U64(64 - BITS)
    for k, size in enumerate(PREFIXES, 1):
        longer = words.ends - words.starts > size
        starts = words.starts[longer]
        index[longer, k] = (ranges_hash(data, starts, starts + size, LOWER) + U64(size)) >> U64(64 - BITS)
    return index.ravel(), np.append(first, len(number)) * FACTORS, np.searchsorted(first * FACTORS, words.rows * FACTORS), words


def distinct_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct features of every row of a chunk."""
    words, sentence, rows, _ = sentences(data, offsets)
    for k in range(len(offsets) - 1):
        yield np.unique(words[sentence[rows[k]] : sentence[rows[k + 1]]])


def instances(used: np.ndarray):
    """A function for mapInArrow: (doc_id, text, label) to (doc_id, label, n_sentences, sentence, word).

    ``sentence`` and ``word`` name the used features in turn: the number among the row's sentences that have any, and the feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                words, sentence, rows, _ = sentences(data, offsets)
                part = batch.slice(row, end - row)
                owner = np.repeat(np.arange(len(sentence) - 1), np.diff(sentence))
                keep = np.flatnonzero(used[words])
                at = np.searchsorted(keep, sentence[rows])
                numbers, names = [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    numbers.append(np.unique(owner[keep[a:b]], return_inverse=True)[1].astype(np.int32).tobytes())
                    names.append(words[keep[a:b]].astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), pa.array(np.diff(rows)), pa.array(numbers, pa.binary()), pa.array(names, pa.binary())], names=["doc_id", "label", "n_sentences", "sentence", "word"]
                )

    return run


class NoisyOr:
    """Word weights and the bias of a sentence's log-odds."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_logits(self, words: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        return self.bias + row_sums(self.weights[words], sentence)


def fit_noisy_or(rows: list, held: dict[int, int], counts: dict[int, int], steps: int = 200, penalty: float = 2e-3, leak: float = 0.02) -> NoisyOr:
    """Maximum likelihood under a quadratic penalty, stronger for rarer words; features only add toxicity.

    rows: those of :func:`instances`; held: how many rows have each feature in use. ``leak`` is the chance of a toxic label without a
    toxic sentence: it keeps wrong labels from being learned by heart.
    """
    size = 1 << BITS
    rows = [r for r in rows if r["n_sentences"]]
    label = np.array([r["label"] for r in rows])
    if not (label == 1).any() or not (label == 0).any():
        return NoisyOr(np.zeros(size), -1e9)
    numbers, texts = ([np.frombuffer(r[c], np.int32) for r in rows] for c in ("sentence", "word"))
    some = np.array([x.max(initial=-1) + 1 for x in numbers], np.int64)  # sentences that have a feature
    bare = np.array([r["n_sentences"] for r in rows]) - some
    first = np.cumsum(some) - some
    sentence_of = np.concatenate([x + f for x, f in zip(numbers, first, strict=True)])
    rows_at = np.repeat(np.arange(len(rows)), some)
    names, words = np.unique(np.concatenate(texts), return_inverse=True)
    weight = penalty / np.array([held[int(n)] for n in names], float)
    share = np.where(label == 1, counts.get(1, 0) / (label == 1).sum(), counts.get(0, 0) / (label == 0).sum())
    share = share / share.sum()

    def gradient(w, b):
        z = b + np.bincount(sentence_of, w[words], len(rows_at))
        total = np.bincount(rows_at, np.logaddexp(0, z), len(rows)) + bare * np.logaddexp(0, b)
        # A toxic row's loss is -log(1 - (1 - leak) exp(-total)), another row's is total.
        clean = (1 - leak) * np.exp(-total)
        outer = share * np.where(label == 1, -clean / (1 - clean), 1.0)
        r = np.clip(outer[rows_at] * sigmoid(z), -1, 1)
        return np.bincount(words, r[sentence_of], len(names)) + weight * w, r.sum() + bare @ np.clip(outer * sigmoid(np.array(b)), -1, 1)

    start = -np.log(max(1.0, (some + bare).sum() / len(rows))) - 2.0
    w, b = adam(lambda w, b: gradient(w, b + start), len(names), steps, 0.1, 0.0)
    weights = np.zeros(size)
    weights[names] = w
    return NoisyOr(weights, b + start)


VERDICT = "doc_id long, held_out boolean, score double, n_toxic_sentences int, worst_sentence int, worst_score double, worst_start long, worst_end long"


def score_documents(model: NoisyOr, threshold: float):
    """A function for mapInArrow: (doc_id, held_out, text) to VERDICT.

    The worst sentence is the first of the highest score, if that reaches ``threshold``; start and end count bytes of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                words, sentence, rows, found = sentences(data, offsets)
                logits = model.sentence_logits(words, sentence)
                scores = -np.expm1(-row_sums(np.logaddexp(0, logits), rows))
                p = sigmoid(logits)
                many = row_sums(p >= threshold, rows)
                worst: dict[str, list] = {"worst_sentence": [], "worst_score": [], "worst_start": [], "worst_end": []}
                for k, n in enumerate(many.tolist()):
                    s = int(rows[k] + p[rows[k] : rows[k + 1]].argmax()) if n else 0
                    start, stop = (found.starts[sentence[s] // FACTORS], found.ends[sentence[s + 1] // FACTORS - 1]) if n else (0, 0)
                    for name, v in zip(worst, (s - rows[k], p[s] if n else 0, start - offsets[k], stop - offsets[k]), strict=True):
                        worst[name].append((float(v) if name == "worst_score" else int(v)) if n else None)
                part = batch.slice(row, end - row)
                kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array(v, kind) for v, kind in zip(worst.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array(many, pa.int32()), *columns], names=["doc_id", "held_out", "score", "n_toxic_sentences", *worst])

    return run


def locate(model: NoisyOr, threshold: float):
    """A function for mapInArrow: (doc_id, text) to one row for each sentence whose score reaches ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "sentence": [], "score": [], "span": []}
            for row, end, data, offsets in chunks(batch.column("text")):
                words, sentence, rows, found = sentences(data, offsets)
                p = sigmoid(model.sentence_logits(words, sentence))
                for s in np.flatnonzero(p >= threshold):
                    k = int(np.searchsorted(rows, s, "right")) - 1
                    out["doc_id"].append(batch.column("doc_id")[row + k].as_py())
                    out["sentence"].append(int(s - rows[k]))
                    out["score"].append(float(p[s]))
                    span = data[found.starts[sentence[s] // FACTORS] : found.ends[sentence[s + 1] // FACTORS - 1]]
                    out["span"].append(span.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("sentence", pa.int32()), ("score", pa.float64()), ("span", pa.string())]))

    return run


def fit_toxicity(documents: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_class: int = 1500, least: int = 3) -> NoisyOr:
    """The model over features that ``least`` toxic documents have, at twice the rate of other documents or more."""
    ids, counts = labelled_ids(labels, label, allowed, per_class)
    scratch = Scratch(documents.sparkSession, "toxic")
    sample = take(documents, ids, scratch)
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ratio = 2 * F.col("n0") * n.get(1, 0) < F.col("n1") * max(1, n.get(0, 0))
    found = count_features(sample, distinct_features, 1 << BITS, (F.col("n1") >= least) & ratio & (F.col("index") > 0))
    held = dict(zip(found["index"].to_pylist(), (a + b for a, b in zip(found["n0"].to_pylist(), found["n1"].to_pylist(), strict=True)), strict=True))
    used = np.zeros(1 << BITS, bool)
    used[list(held)] = True
    rows = sample.mapInArrow(instances(used), "doc_id long, label int, n_sentences long, sentence binary, word binary").orderBy("doc_id").collect()
    scratch.drop("sample")
    return fit_noisy_or(rows, held, counts)


def classify_toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", per_class: int = 1500, threshold: float = 0.5) -> DataFrame:
    """VERDICT and predicted of every document; ``held_out`` is an expression on doc_id."""
    model = fit_toxicity(documents, labels, ~held_out, label, per_class)
    scored = documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(tidy(score_documents(model, threshold)), VERDICT)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxic_sentences(documents: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence number, score, span) of every offending sentence."""
    return documents.select("doc_id", "text").mapInArrow(locate(model, threshold), "doc_id long, sentence int, score double, span string")

"""Language identification: blended-spectrum n-gram presence kernel, Nystroem landmarks, ridge regression.

A text is the set of its hashed 1-, 2- and 3-byte grams (A-Z folded). The kernel of two texts is the number of
grams in both over the root of the product of their set sizes. Landmark texts give the Nystroem feature map
``K(x, landmarks) K(landmarks, landmarks)^(-1/2)``, in which one ridge regression per language is
fitted against all the others. A batch is scored by two matrix products.

Bounds: about ``per_language`` texts of every language are fitted (chosen by a hash of the id), all languages that occur; every
language has landmarks of its own, MOST_MARKS each or fewer where languages are many (see :func:`marks_each`). The driver holds
the fitted texts as packed bits and takes them in blocks. Every document is predicted, from its whole text.

Defined cases: text that is null or has no letter is ``und`` with score 0; without anything to learn from all
are ``und``; ties go to the language that sorts first; repeated rows are predicted alike; a null doc_id is
never learned from and is not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.textkernel import LOWER, chunks, row_sums, tidy

GRAMS = 1 << 13
MOST_ROWS = 256
MOST_MARKS, LEAST_MARKS = 40, 4  # landmarks of a language
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by GRAMS matrix of 0 and 1: which hashed grams each text has."""
    rows = len(offsets) - 1
    out = np.zeros(rows * GRAMS, np.float32)
    folded = LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    last = np.repeat(offsets[1:], np.diff(offsets))
    value = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        if len(data) < n:
            break
        size = len(data) - n + 1
        value = value[:size] | folded[n - 1 :] << np.uint32(8 * (n - 1))
        slot = ((value + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(19)
        fits = np.arange(size) + n <= last[:size]
        out[(row[:size] * GRAMS + slot)[fits]] = 1
    return out.reshape(rows, GRAMS)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = row_sums(_LETTER[data], offsets) > 0
    for k in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def small_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``chunks``, with at most MOST_ROWS rows, so that the presence matrix stays small."""
    for at in range(0, len(column), MOST_ROWS):
        for row, end, data, offsets in chunks(column.slice(at, MOST_ROWS)):
            yield at + row, at + end, data, offsets


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x GRAMS, 0 or 1
    weights: np.ndarray  # landmarks x languages: the feature map's root times the ridge coefficients

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, score from 0 to 1) of each row."""
        values = kernel(presence(data, offsets), self.landmarks) @ self.weights
        best = values.argmax(1)
        share = np.clip(values, 1e-6, None)
        return best, np.clip(share[np.arange(len(best)), best] / share.sum(1), 0, 1)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(1, x.sum(1)))[:, None] * np.sqrt(np.maximum(1, y.sum(1)))[None, :]
    return (x @ y.T) / sizes


def marks_each(languages: int) -> int:
    """Landmarks of each language: MOST_MARKS for up to 16 languages, then fewer, but never under LEAST_MARKS."""
    return max(LEAST_MARKS, min(MOST_MARKS, 16 * MOST_MARKS // languages))


def _unpack(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)


def fit(rows: list[tuple[str, bytes]], ridge: float = 1e-3) -> Model | None:
    """Model from (language, packed presence bits)."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    own = np.array([number[lang] for lang, _ in rows])
    taken = [0] * len(languages)
    chosen, each = [], marks_each(len(languages))
    for k, c in enumerate(own.tolist()):
        taken[c] += 1
        if taken[c] <= each:
            chosen.append(k)
    marks = _unpack([rows[k][1] for k in chosen])
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vector * np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0) @ vector.T
    square, cross = ridge * np.eye(len(chosen)), np.zeros((len(chosen), len(languages)))
    for at in range(0, len(rows), MOST_ROWS):
        part = own[at : at + MOST_ROWS]
        phi = kernel(_unpack([bits for _, bits in rows[at : at + MOST_ROWS]]), marks) @ root
        weighted = phi / (np.array(taken)[part] * len(languages))[:, None]
        square += weighted.T @ phi
        np.add.at(cross.T, part, weighted)
    coefficients = np.linalg.solve(square, cross)
    return Model(languages, marks, (root @ coefficients).astype(np.float32))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, keep = [], []
        for row, end, data, offsets in small_chunks(batch.column("text")):
            keep += [row + k for k in np.flatnonzero(has_letter(data, offsets))]
            x = np.packbits(presence(data, offsets).astype(bool), axis=1)
            bits += [x[k].tobytes() for k in np.flatnonzero(has_letter(data, offsets))]
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])


def predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for row, end, data, offsets in small_chunks(batch.column("text")) if model else ():
                known = has_letter(data, offsets)
                best, score = model.predict(data, offsets)
                names[row:end] = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                scores[row:end] = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(documents: DataFrame, held_out: Column, per_language: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learns from text and non-null lang where not held out."""
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    counts = usable.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    model = None
    if counts:
        rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * per_language / r["count"])))])
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
        sample = usable.where(draw < F.coalesce(rate[F.col("lang")], F.lit(0.0))).select("doc_id", "lang", "text")
        rows = sample.mapInArrow(tidy(packed), "doc_id long, lang string, bits binary").dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "bits").collect()
        taken: dict[str, int] = {}
        fitted = []
        for r in rows:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            if taken[r["lang"]] <= per_language:
                fitted.append((r["lang"], bytes(r["bits"])))
        model = fit(fitted)
    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(tidy(predict(model)), "doc_id long, held_out boolean, lang_pred string, score double")

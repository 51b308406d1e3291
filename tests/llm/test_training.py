"""Training steps and scores against plain restatements of what they should be."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa

from girder.llm import language_id, toxicity
from girder.llm.features import FAMILIES, SIZE, Sparse, sigmoid
from girder.llm.quality_classifier import fit_pu
from girder.llm.quality_rules import fit_calibrated
from girder.llm.textkernel import LOWER, ranges_hash, text_bytes


def sample(rng, rows, features=30):
    """Rows of a sample in which some features tell the label and most do not."""
    out = []
    for k in range(rows):
        label = int(k % 3 != 0)
        index = np.unique(np.concatenate([rng.integers(0, features, 8), [features + label if rng.random() < 0.9 else features + 2]])).astype(np.int32)
        out.append({"doc_id": k, "label": label, "index": index.tobytes(), "value": rng.random(len(index)).astype(np.float32).tobytes()})
    return out


def dense(rows):
    x = np.zeros((len(rows), FAMILIES * SIZE))
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["index"], np.int32)] = np.frombuffer(r["value"], np.float32)
    return x


def flat_at(risk, w, b, rng):
    """The steepest of some directions, as a share of the steepest at zero."""
    def steepest(w, b):
        out = []
        for _ in range(12):
            d, db, e = rng.normal(size=len(w)), rng.normal(), 1e-5
            out.append(abs(risk(w + e * d, b + e * db) - risk(w - e * d, b - e * db)) / (2 * e))
        return max(out)

    return steepest(w, b) / steepest(0 * w, 0.0)


def test_sparse_products():
    rng = np.random.default_rng(1)
    rows = sample(rng, 40)
    x = dense(rows)
    made = Sparse(list(rows))
    scaled = x[:, made.names] * made.scale
    w, r = rng.normal(size=made.size), rng.normal(size=40)
    assert np.allclose(made.dot(w), scaled @ w) and np.allclose(made.back(r), scaled.T @ r)
    assert np.allclose((scaled**2).mean(0), 1, atol=0.05)
    assert np.isclose(made.curvature(np.full(40, 1 / 40)), np.linalg.eigvalsh(scaled.T @ scaled / 40)[-1], rtol=0.1)


def test_unlabelled_risk_is_minimised():
    rng = np.random.default_rng(2)
    rows = sample(rng, 300)
    label = np.array([r["label"] for r in rows])
    x = Sparse(list(rows))
    model, prior = fit_pu(list(rows), lambda models, seen: [[] for _ in models])
    assert 0.01 <= prior <= 0.99
    pos, unl = (label == 1) / (label == 1).sum(), (label == 0) / (label == 0).sum()

    def risk(w, b):
        s = sigmoid(x.dot(w) + b)  # the sigmoid loss of a wrong positive; 1 - s is that of a wrong negative
        return prior * pos @ (1 - s) + max(0.0, unl @ s - prior * pos @ s) + 0.5e-4 * w @ w

    w = model.weights[x.names] / x.scale
    assert risk(w, model.bias) < 0.5 * risk(0 * w, 0.0)


def test_logistic_regression_is_at_its_minimum():
    rng = np.random.default_rng(3)
    rows = sample(rng, 250)
    label = np.array([r["label"] for r in rows])
    x = Sparse(list(rows))
    model = fit_calibrated(list(rows), {0: int((label == 0).sum()), 1: int((label == 1).sum())})
    train = np.arange(len(rows)) % 5 != 4
    weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()) * train

    def risk(w, b):
        return weight @ np.logaddexp(0, np.where(label == 1, -1, 1) * (x.dot(w) + b)) + 0.5e-4 * w @ w

    w = model.weights[x.names] / x.scale
    assert flat_at(risk, w, model.bias, rng) < 0.1
    p = sigmoid(model.slope * (x.dot(w) + model.bias) + model.shift)[~train]
    assert abs(p.mean() - label[~train].mean()) < 0.1  # calibrated on these rows


def one_hash(text: bytes, size: int = 0) -> int:
    data = np.frombuffer(text, np.uint8)
    return int((ranges_hash(data, np.array([0]), np.array([len(text)]), LOWER) + np.uint64(size))[0] >> np.uint64(64 - toxicity.BITS))


def test_noisy_or_scores():
    rng = np.random.default_rng(4)
    model = toxicity.NoisyOr(rng.normal(0, 0.4, 1 << toxicity.BITS), -2.0)
    model.weights[0] = 0.0
    texts = ["Some words here. And more words! 3.14 is a number?", "", "...", "one", "É é\nline two  of it", "x" * 30 + " " + "Long words " * 40]
    data, offsets = text_bytes(pa.array(texts))
    scored = next(toxicity.score_documents(model, 0.5)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "held_out": [False] * 6, "text": texts})])))
    for k, text in enumerate(texts):
        rest = 1.0
        best = 0.0
        for sentence in re.split(rb"[.!?\n]", text.encode()):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
            if words:
                z = model.bias
                for word in words:
                    z += model.weights[one_hash(word)] + sum(model.weights[one_hash(word[:n], n)] for n in toxicity.PREFIXES if len(word) > n)
                rest *= 1 - 1 / (1 + math.exp(-z))
                best = max(best, 1 / (1 + math.exp(-z)))
        assert math.isclose(scored["score"][k].as_py(), 1 - rest, abs_tol=1e-9)
        assert (scored["worst_score"][k].as_py() or 0.0) == (best if best >= 0.5 else 0.0) or math.isclose(scored["worst_score"][k].as_py(), best, rel_tol=1e-9)


def test_noisy_or_learns_from_long_documents(spark):
    """Words that are toxic in very long documents only are learned: no length is left out."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(40):
        body = [". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4500 if k < 8 else 30))]
        texts.append((k, ". ".join([*body, "some vileness there" if k < 8 else "some kindness there"])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    given = spark.createDataFrame([(k, int(k < 8)) for k in range(40)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.fit_toxicity(docs, given, F.lit(True))
    assert len(texts[0][1].split()) > 50_000
    assert model.weights[one_hash(b"vileness")] > 0 and {r.doc_id for r in toxicity.toxic_sentences(docs, model).collect()} == set(range(8))


def test_presence_kernel():
    texts = ["Abcab", "abc", "xyz", "a", "naïve ab"]
    data, offsets = text_bytes(pa.array(texts))
    made = language_id.presence(data, offsets)

    def slots(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        grams = {raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)}
        return {((int.from_bytes(g, "little") + (len(g) << 24)) * 0x9E3779B1 & 0xFFFFFFFF) >> 19 for g in grams}

    sets = [slots(t) for t in texts]
    assert [set(np.flatnonzero(row).tolist()) for row in made] == sets
    wanted = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(language_id.kernel(made, made), wanted)


def test_ridge_equals_the_closed_form():
    """With every text a landmark the fit is weighted kernel ridge regression: f = K (K + ridge / weight)^-1 Y."""
    rng = random.Random(6)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    rows = [(lang, "".join(rng.choice(signs) for _ in range(14))) for lang, signs in alphabets.items() for _ in range(12)]
    rng.shuffle(rows)
    data, offsets = text_bytes(pa.array([t for _, t in rows]))
    x = language_id.presence(data, offsets)
    model = language_id.fit([(lang, np.packbits(p.astype(bool)).tobytes()) for (lang, _), p in zip(rows, x, strict=True)], ridge=1e-2)
    y = np.array([[lang == c for c in sorted(alphabets)] for lang, _ in rows], float)
    k = language_id.kernel(x, x).astype(float)
    weight = 1 / (12 * 3)
    wanted = k @ np.linalg.solve(k + 1e-2 / weight * np.eye(len(rows)), y)
    assert np.allclose(language_id.kernel(x, model.landmarks) @ model.weights, wanted, atol=1e-3)
    assert language_id.marks_each(4) == 40 and language_id.marks_each(1000) == 4


def test_every_language_is_learned(spark):
    from pyspark.sql import functions as F

    stems = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for k in range(520)]
    rows = [(k, f"{stems[k % 520]} {stems[k % 520][k % 7 : 50]}", f"l{k % 520:03}") for k in range(1560)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language_id.identify_language(docs, F.lit(False)).collect()
    known = {k: lang for k, _, lang in rows}
    assert sum(r.lang_pred == known[r.doc_id] for r in made) / len(made) > 0.95

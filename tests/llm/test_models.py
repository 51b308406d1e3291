"""Trained operators: held-out accuracy, odd inputs, and the base rules against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from girder.llm import language_id, quality_classifier, quality_rules, queries, toxicity
from girder.llm.features import remainder
from girder.llm.quality_classifier import estimate_prior
from tests.llm.brute import WORD
from tests.llm.conftest import odd_rows, prose

SF = "/root/testdata/sf0.01"


def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(doc_id: int, by: int, rest: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % by == rest


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    again = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark, odd, none, no_labels):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    known = labels(spark)
    rows = queries.op4_quality_rules(spark, SF).collect()
    right = 0
    for r in rows:
        n, chars, symbols, lines, again = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again)
        assert r.base_failed == (n < 10 or 100 * again > 20 * n) and not (r.base_failed and r.kept)
        if r.doc_id in known and not r.base_failed:
            right += r.kept == (known[r.doc_id].quality == 1)
    judged = sum(r.doc_id in known and not r.base_failed for r in rows)
    assert right / judged > 0.97
    found = {r.doc_id: r for r in quality_rules.apply_quality_rules(odd, no_labels).collect()}
    for d, text, _ in odd_rows():
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text)
        assert r.kept == (not r.base_failed)  # without labels the model accepts everything
    kept = quality_rules.keep_good(odd, no_labels)
    assert kept.columns == odd.columns and kept.count() == sum(found[d].kept for d, _, _ in odd_rows())
    assert quality_rules.apply_quality_rules(none, no_labels).count() == 0


def test_quality_rules_on_labels_not_fitted(spark):
    known = labels(spark)
    out = remainder(F.col("doc_id"), 4) == 2
    given = spark.read.parquet(f"{SF}/labels.parquet").where(~out)
    rows = quality_rules.apply_quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), given).collect()
    held_rows = [r for r in rows if held(r.doc_id, 4, 2) and r.doc_id in known and not r.base_failed]
    wrong = sum(r.kept != (known[r.doc_id].quality == 1) for r in held_rows)
    assert len(held_rows) > 50 and wrong / len(held_rows) < 0.05


def test_quality_rules_fit_size(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(3200)], "doc_id long, text string")
    given = spark.createDataFrame([(k, k % 2) for k in range(3200)], "doc_id long, quality int")
    fit, met = quality_rules.fit_calibrated, []
    monkeypatch.setattr(quality_rules, "fit_calibrated", lambda rows, counts: met.append(len(rows)) or fit(rows, counts))
    quality_rules.apply_quality_rules(docs, given)
    quality_rules.keep_good(docs, given)
    assert met == [3000, 3000]


def accuracy(rows, known, label):
    return sum(r.predicted == known[r.doc_id][label] for r in rows) / len(rows)


def test_quality_classifier(spark, odd, none, no_labels):
    known = labels(spark)
    rows = queries.op3_quality_classifier(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert accuracy([r for r in rows if r.held_out and r.doc_id in known], known, "quality") > 0.95
    out = remainder(F.col("doc_id"), 3) == 1
    made = quality_classifier.classify_quality(odd, no_labels, out).collect()
    assert len(made) == len(odd_rows()) and {r.score for r in made} == {0.5} and not [r for r in made if r.held_out is None]
    assert quality_classifier.classify_quality(none, no_labels, out).count() == 0


def test_prior_estimate():
    import numpy as np

    rng = np.random.default_rng(0)
    positive, negative = rng.normal(3, 1, 2000), rng.normal(-3, 1, 600)
    assert abs(estimate_prior(positive[:1000], np.concatenate([positive[1000:], negative])) - 1000 / 1600) < 0.05


def test_prior_counts_all_unlabelled(spark, monkeypatch):
    import numpy as np

    docs = [(k, prose(k, 30) + ("" if k % 3 else " $$$ BUY ### NOW" * 5)) for k in range(900)]
    docs = spark.createDataFrame([*docs, docs[-1]], "doc_id long, text string")
    given = spark.createDataFrame([(k, 1) for k in range(900) if k % 3 and k % 2], "doc_id long, quality int")
    met = []

    def spy(positive, unlabelled, *rest, counts=None, **more):
        met.append(len(unlabelled) if counts is None else int(np.sum(counts)))
        met.append(estimate_prior(positive, unlabelled, *rest, counts=counts, **more))
        return met[-1]

    monkeypatch.setattr(quality_classifier, "estimate_prior", spy)
    quality_classifier.classify_quality(docs, given, F.lit(False), most_positive=40, most_unlabelled=40)
    assert len(met) == 4  # the models of both halves
    for counted, prior in (met[:2], met[2:]):
        assert 600 - 40 <= counted <= 600  # all without labels but those that the model was fitted on
        assert 0.3 < prior < 0.6  # half are like the positives


def test_toxicity(spark, odd, none, no_labels):
    known = labels(spark)
    rows = queries.op9_toxicity(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    of = [r for r in rows if r.held_out and r.doc_id in known]
    assert accuracy(of, known, "toxic") > 0.92
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert (r.n_toxic_sentences > 0) == (r.worst_sentence is not None) == (r.worst_score is not None)
        if r.worst_score is not None:
            assert 0.5 <= r.worst_score <= r.score + 1e-9
            span = texts[r.doc_id][r.worst_start : r.worst_end]
            assert span and not set(b".!?\n") & set(span)
    toxic, clean = ([r.score for r in of if known[r.doc_id].toxic == c] for c in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.9
    out = remainder(F.col("doc_id"), 5) == 0
    made = toxicity.classify_toxicity(odd, no_labels, out).collect()
    assert len(made) == len(odd_rows()) and {r.score for r in made} == {0.0}
    assert toxicity.classify_toxicity(none, no_labels, out).count() == 0


def test_toxicity_of_held_out_documents(spark):
    larger = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [r for r in queries.op9_toxicity(spark, larger).select("doc_id", "held_out", "predicted").collect() if r.held_out and r.doc_id in toxic]
    caught = sum(r.predicted and toxic[r.doc_id] for r in rows)
    assert caught / sum(toxic[r.doc_id] for r in rows) > 0.7  # recall
    assert caught / sum(r.predicted for r in rows) > 0.9  # precision


def test_toxic_sentences(spark):
    docs = spark.createDataFrame([(k, f"Fine words here. Some {'vile' if k % 2 else 'nice'} stuff{k}! More text?") for k in range(200)], "doc_id long, text string")
    given = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, given, F.lit(True))
    found = toxicity.toxic_sentences(docs, model).collect()
    assert {(r.doc_id, r.sentence) for r in found} == {(k, 1) for k in range(1, 200, 2)}
    assert found[0].span.startswith("Some vile")


def test_language_id(spark, odd, none):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in rows)
    of = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in of) / len(of) > 0.97
    out = remainder(F.col("doc_id"), 5) == 0
    found = {r.doc_id: r.lang_pred for r in language_id.identify_language(odd, out).collect()}
    assert all(found[d] == "und" for d in (2, 3, 4, 14)) and found[1] in ("en", "fr", "de") and found[11] != "und"
    assert language_id.identify_language(none, out).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_language(unlabelled, out).collect()} == {"und"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    from pathlib import Path

    import duckdb

    connection = duckdb.connect()
    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    made = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    wanted = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in made.select(*sorted(columns)).collect()) == wanted

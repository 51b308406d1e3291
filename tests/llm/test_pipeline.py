"""The corpus pipeline: the rows of every stage against brute force, and odd and empty tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from girder.llm import quality_rules, queries
from girder.scratch import Scratch
from tests.llm.brute import WORD, components, removed, shingles
from tests.llm.conftest import make_docs, odd_rows, prose
from tests.llm.test_models import base

SF = "/root/testdata/sf0.001"


def quality(spark, rows, docs):
    """The base rules by brute force and the model's verdicts as given."""
    kept = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in quality_rules.apply_quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    out = []
    for d, t in rows:
        n, chars, _, _, again = base(t)
        if n >= 10 and 100 * again <= 20 * n and kept[d, n, chars]:
            out.append((d, t))
    return out


def near_duplicates(spark, rows, docs):
    found = components([(d, t) for d, t in rows if d is not None])
    return [(d, t) for d, t in rows if d is None or found[d][1] == d]


def passages(spark, rows, docs):
    known = removed(list(dict.fromkeys((d, t) for d, t in rows if d is not None)))
    return [(d, t if d is None or t is None else known[d][3].decode("utf-8", "ignore")) for d, t in rows]


def decontamination(spark, rows, docs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    needs = [(min(5, len(WORD.findall(t or ""))), shingles(t)) for t in items]
    out = []
    for d, t in rows:
        many = len(WORD.findall(t or ""))
        hit = any(need and many >= width and 4 * len(need & shingles(t, width)) >= 3 * len(need) for width, need in needs)
        out += [] if hit else [(d, t)]
    return out


def tokens(spark, rows, docs):
    return [(d, t or "") for d, t in rows]


STAGES = (quality, near_duplicates, passages, decontamination, tokens)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("source", ["given", "odd"])
def test_stages_equal_brute_force(spark, odd, source):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if source == "odd":
        bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
        copies = [(k, prose(50, 120) + (" more" if k % 2 else ""), "en") for k in range(60, 66)]
        docs = make_docs(spark, [*odd_rows(), *copies, (70, prose(70, 200) + " " + bench + " " + prose(71, 200), "en"), (71, prose(72, 90) + prose(70, 200)[:300] + prose(73, 90), "en")])
    names = docs.columns
    for number, ((name, stage), brute) in enumerate(zip(corpus_pipeline.STAGES, STAGES, strict=True)):
        rows = plain(docs)
        if source == "odd" and number == 0:
            made = docs  # the odd texts are kept for the stages behind
        else:
            made = scratch.save(stage(spark, docs, SF), str(number))
            assert ordered(plain(made)) == ordered(brute(spark, rows, docs)), name
        if number < len(STAGES) - 1:
            assert made.columns == names
        docs = made
    assert docs.where("n_tokens != size(token_ids)").count() == 0 and docs.count() > 10


def test_tokens_are_those_of_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    for r in corpus_pipeline.token_stage(spark, odd, SF).collect():
        assert list(r.token_ids) == library.encode(r.text, add_special_tokens=False).ids


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        made = stage(spark, odd, SF)
        assert set(odd.columns) <= set(made.columns) and made.count() <= odd.count(), name
    kept = {r.doc_id: r for r in corpus_pipeline.passage_stage(spark, odd, SF).collect()}
    assert kept[2].text is None and kept[2].n_chars == 0 and kept[6].n_chars == 0

"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (session, documents, folder of the tables) and returns documents with the same columns; the last
one adds the token ids and returns the text decoded from them. ``run`` writes every stage's result as
Parquet in the shared folder and rereads it for the next stage.

Defined cases: an empty table stays empty at every stage; repeated rows are treated alike, and stay or go together but for
the near-duplicate stage, which keeps all rows of the doc_id that stays; columns that no stage reads pass unchanged, whatever
their names, but the last stage's own (token_ids, n_tokens), which replace others of these names. What the stages do with nulls and empty texts,
their docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import bpe, decontaminate, jaccard_join, quality_rules, suffix_dedup
from girder.llm.queries import TOKENIZER
from girder.scratch import Scratch, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated model go; null and empty texts have too few words and go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; null ids and texts without words stay."""
    return jaccard_join.keep_representatives(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the text; n_chars follows. Null texts keep theirs, null ids their text."""
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", n_chars)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them; a null text has no tokens and becomes empty."""
    return bpe.roundtrip(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding and decoding", token_stage),
]

#: The quality stage is a trained model, which SQL cannot express; tests/llm/test_pipeline.py holds the rows of every stage against brute
#: force, with the model's verdicts as given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(number))
        if number:
            scratch.drop(str(number - 1))
    return docs

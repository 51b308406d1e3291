"""Continuous checking: models that land as new partitions are evaluated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from girder.operators.report import report_rows
from girder.plans.evaluate import evaluate_document
from girder.plans.rules import Document
from girder.schema import ENTITIES
from girder.sources.store import ModelStore


def revalidate(spark: SparkSession, store_root: str, document: Document, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends report rows, by batch and specification, for every model whose entities appear in the store.

    A batch only names the models; the tables are read from the store, so that a batch that is run again gives the same rows
    and replaces its own folder.
    """
    stream = spark.readStream.schema(ENTITIES).parquet(f"{store_root}/entities").select("model_id")

    def check(batch: DataFrame, number: int) -> None:
        models = [r[0] for r in batch.distinct().collect()]  # models of one batch, not rows
        if not models:
            return
        tables = ModelStore(spark, store_root).load(models)
        results = evaluate_document(tables, document, lenient=True)
        for spec in document.specifications:
            report_rows(results[spec.id], spec).write.mode("overwrite").parquet(f"{out}/batch={number}/spec={spec.id}")

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

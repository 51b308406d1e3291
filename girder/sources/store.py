"""Base tables on disk: a store partitioned by model, snapshots of models, and a cache of snapshots.

Paths are Hadoop paths; everything goes through Spark's own readers and writers and its file system.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from girder.functions.errors import StaleSnapshotError
from girder.schema import BASE_TABLES, ModelTables

#: Snapshots of another format are refused; raise it whenever what the tables mean changes.
FORMAT = "girder-1"
_MANIFEST = "_manifest.json"


@dataclass(frozen=True)
class _Files:
    spark: SparkSession

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def delete(self, path: str) -> bool:
        target, system = self._at(path)
        return system.delete(target, True)

    def exists(self, path: str) -> bool:
        target, system = self._at(path)
        return system.exists(target)

    def names(self, path: str) -> list[str]:
        target, system = self._at(path)
        return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []

    def write(self, path: str, text: str) -> None:
        target, system = self._at(path)
        out = system.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        target, system = self._at(path)
        stream = system.open(target)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class ModelStore:
    """Tables partitioned by model_id; saving a model replaces its partitions in all tables and no others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark)

    def save(self, tables: ModelTables, model_ids: Iterable[str] | None = None) -> None:
        """Write the models of ``tables``; of ``model_ids`` those that a table has no rows of lose what it has of them so far."""
        frames = tables.as_dict()
        present = {name: {r[0] for r in df.select("model_id").distinct().collect()} for name, df in frames.items()}  # one row per model
        saved = set(model_ids or ()).union(*present.values())
        for name, df in frames.items():
            df.repartition("model_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(f"{self.root}/{name}")
            for model_id in saved - present[name]:
                self.files.delete(f"{self.root}/{name}/model_id={model_id}")

    def load(self, model_ids: list[str] | None = None) -> ModelTables:
        found = {}
        for name, schema in BASE_TABLES.items():
            path = f"{self.root}/{name}"
            df = self.spark.read.schema(schema).parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], schema)
            found[name] = df.select(*schema.names)
        return ModelTables(*(found[n] for n in BASE_TABLES)).where_models(model_ids)

    def drop(self, model_id: str) -> None:
        for name in BASE_TABLES:
            self.files.delete(f"{self.root}/{name}/model_id={model_id}")

    def models(self) -> list[str]:
        return sorted(n.removeprefix("model_id=") for n in self.files.names(f"{self.root}/entities") if n.startswith("model_id="))


def export_snapshot(tables: ModelTables, path: str) -> None:
    """One Parquet folder per table, and last a manifest, so that a broken export is no snapshot."""
    for name, df in tables.as_dict().items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    _Files(tables.spark).write(f"{path}/{_MANIFEST}", json.dumps({"format": FORMAT, "tables": list(BASE_TABLES), "saved_at": time.time()}))


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        manifest = json.loads(_Files(spark).read(f"{path}/{_MANIFEST}"))
    except Exception as error:
        raise StaleSnapshotError(f"no readable manifest in {path}") from error
    if manifest.get("format") != FORMAT or set(manifest.get("tables", ())) != set(BASE_TABLES):
        raise StaleSnapshotError(f"{path} has another format")
    return manifest


def import_snapshot(spark: SparkSession, path: str) -> ModelTables:
    read_manifest(spark, path)
    return ModelTables(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in BASE_TABLES.items()))


class ModelCache:
    """A store of parsed models and a catalogue: one small file per change, replayed in the order of their names.

    An entry is written after its tables, so a broken save is no model. Models of another format are purged when listed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark)
        self.store = ModelStore(spark, f"{self.root}/tables")

    def _note(self, **entry) -> None:
        self.files.write(f"{self.root}/catalogue/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps({"format": FORMAT, "at": time.time(), **entry}))

    def _known(self) -> dict[str, tuple[str, float]]:
        """Format and time of saving of every model that was not deleted since."""
        known: dict[str, tuple[str, float]] = {}
        for name in sorted(n for n in self.files.names(f"{self.root}/catalogue") if n.endswith(".json")):
            try:
                entry = json.loads(self.files.read(f"{self.root}/catalogue/{name}"))
                known.update((m, (entry["format"], entry["at"])) for m in entry.get("saved", ()))
                for m in entry.get("deleted", ()):
                    known.pop(m, None)
            except (ValueError, KeyError, TypeError):  # no entry: what it was about counts as not saved
                continue
        return known

    def write(self, model_id: str, tables: ModelTables) -> None:
        self.write_all([model_id], tables.where_models([model_id]))

    def write_all(self, model_ids: list[str], tables: ModelTables) -> None:
        """Save the models with one write per table; ``tables`` has no others."""
        self.store.save(tables, model_ids)
        self._note(saved=list(model_ids))

    def restore(self, model_id: str) -> ModelTables | None:
        return self.store.load([model_id]) if model_id in self.saved() else None

    def saved(self) -> set[str]:
        return {m for m, (kind, _) in self._known().items() if kind == FORMAT}

    def list(self) -> list[tuple[str, float]]:
        """(model_id, time of saving), newest first."""
        known = self._known()
        for model_id, (kind, _) in known.items():
            if kind != FORMAT:
                self.delete(model_id)
        return sorted(((m, at) for m, (kind, at) in known.items() if kind == FORMAT), key=lambda x: (-x[1], x[0]))

    def delete(self, model_id: str) -> None:
        self._note(deleted=[model_id])
        self.store.drop(model_id)

    def clear(self) -> None:
        self.files.delete(self.root)


def load_models(spark: SparkSession, path: str, cache: ModelCache | None = None, profile: str = "learning") -> tuple[list[str], ModelTables]:
    """Read STEP files; files whose content the cache has are restored instead of parsed, all of them in one scan.

    New models are parsed in one job and saved with one write per table. A cache that cannot be written to fails no load.
    """
    from girder.operators.ingest import ingest
    from girder.sources.step import read_files, records

    files = read_files(spark, path)
    ids = sorted(r[0] for r in files.select("model_id").distinct().collect())  # one row per file
    saved = cache.saved() if cache is not None else set()
    known, fresh = [m for m in ids if m in saved], [m for m in ids if m not in saved]
    if not fresh:
        return ids, cache.store.load(known) if cache is not None else ingest(records(files), profile)
    wanted = spark.createDataFrame([(m,) for m in fresh], "model_id string")
    made = ingest(records(files.join(wanted, "model_id", "left_semi").dropDuplicates(["model_id"])), profile)
    if cache is None:
        return ids, made
    try:
        cache.write_all(fresh, made)
        return ids, cache.store.load(ids)
    except Exception as error:
        warnings.warn(f"parsed models were not saved: {error}", stacklevel=2)
    if not known:
        return ids, made
    old = cache.store.load(known).as_dict()
    return ids, ModelTables(*(old[name].unionByName(df) for name, df in made.as_dict().items()))

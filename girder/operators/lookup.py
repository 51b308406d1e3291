"""Elements by uid, and what a model is called."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.guid import to_compressed
from girder.schema import BOX, KEY, ModelTables

MOST_UIDS = 100_000


def uid_keys(uids: DataFrame, column: str = "uid") -> DataFrame:
    """(model_id, entity_id) of well-formed uids, each once; others are dropped."""
    uid = F.col(column)
    number = F.regexp_extract(uid, r"(?s)^(.+):([0-9]+)$", 2)
    keys = uids.where(number != "").select(F.regexp_extract(uid, r"(?s)^(.+):([0-9]+)$", 1).alias("model_id"), number.try_cast("int").alias("entity_id"))
    return keys.where("entity_id IS NOT NULL").distinct()


def ifc_box() -> Column:
    """The box in the model's own z-up axes, null unless all six bounds are there: the stored frame is y-up."""
    x0, y0, z0, x1, y1, z1 = (F.col(c) for c in BOX)
    known = F.array(*BOX)
    return F.when(~F.exists(known, lambda v: v.isNull()), F.array(x0, -z1, y0, x1, -z0, y1))


def element_info(tables: ModelTables, uids: DataFrame | Iterable[str]) -> DataFrame:
    """One row per known uid: class, names, both spellings of the global id, and the box."""
    if not isinstance(uids, DataFrame):
        given = list(uids)
        if len(given) > MOST_UIDS:
            raise ValueError(f"over {MOST_UIDS} uids: pass a DataFrame")
        uids = tables.spark.createDataFrame([(u,) for u in given], "uid string")
    found = tables.entities.join(uid_keys(uids), KEY)
    return found.select(
        F.concat_ws(":", *KEY).alias("uid"), *KEY, "ifc_type", "name", "description", "object_type", "tag", "predefined_type",
        F.coalesce(to_compressed(F.col("global_id")), F.col("global_id")).alias("global_id"), F.col("global_id_canonical").alias("guid"), ifc_box().alias("bbox"),
    )


def model_info(tables: ModelTables) -> DataFrame:
    """(model_id, project_id, name, long_name, global_id) of each model's first project."""
    projects = tables.entities.where(F.upper("ifc_type") == "IFCPROJECT")
    first = F.min_by(F.struct("entity_id", "name", "long_name", "global_id"), "entity_id").alias("p")
    return projects.groupBy("model_id").agg(first).select("model_id", F.col("p.entity_id").alias("project_id"), "p.name", "p.long_name", "p.global_id")

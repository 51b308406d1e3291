"""Tables of a building model as Spark schemas, and the bundle of DataFrames that holds them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TIER1 = {
    "name": "name",
    "globalid": "global_id",
    "description": "description",
    "objecttype": "object_type",
    "tag": "tag",
    "predefinedtype": "predefined_type",
    "longname": "long_name",
    "identification": "identification",
}
BOX = ("bbox_min_x", "bbox_min_y", "bbox_min_z", "bbox_max_x", "bbox_max_y", "bbox_max_z")
MESH = ("vertex_count", "triangle_count", "unique_vertex_count", "mesh_part_count")
KEY = ["model_id", "entity_id"]


def _struct(required: str, optional: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}
    fields = [(f, False) for f in required.split()] + [(f, True) for f in optional.split()]
    return T.StructType([T.StructField(f.split(":")[0], kinds[f.split(":")[1]], null) for f, null in fields])


RECORDS = _struct("model_id:s entity_id:i ifc_type:s args:s ord:l", "")
ENTITIES = _struct(
    "model_id:s entity_id:i ifc_type:s",
    "name:s global_id:s global_id_canonical:s description:s object_type:s tag:s predefined_type:s long_name:s identification:s empty_attrs:s "
    + " ".join(f"{c}:d" for c in BOX) + " " + " ".join(f"{c}:i" for c in MESH),
)
TRIPLES = _struct("model_id:s subject:i predicate:s object:i", "")
PROPERTIES = _struct("model_id:s entity_id:i pset_name:s property_name:s", "value:s value_num:d value_si:d unit:s data_type:s")
ATTRIBUTES = _struct("model_id:s entity_id:i attr_name:s", "value:s")
REPARENT_OPS = _struct("", "id:s node_model_id:s node_entity_id:i parent_model_id:s parent_entity_id:i")
SAMEAS_MEMBERS = _struct("", "op_id:s model_id:s entity_id:i ifc_type:s")

BASE_TABLES = {"entities": ENTITIES, "triples": TRIPLES, "pset_properties": PROPERTIES, "entity_attributes": ATTRIBUTES}


@dataclass(frozen=True)
class ModelTables:
    """The four base tables of any number of models; derived views are built on demand and kept."""

    entities: DataFrame
    triples: DataFrame
    properties: DataFrame
    attributes: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    @cached_property
    def views(self):
        from girder.operators.views import Views

        return Views(self)

    def where_models(self, model_ids: list[str] | None) -> ModelTables:
        """Only the given models; partition pruning does the rest."""
        if model_ids is None:
            return self
        pick = lambda df: df.where(df["model_id"].isin(model_ids))
        return replace(self, entities=pick(self.entities), triples=pick(self.triples), properties=pick(self.properties), attributes=pick(self.attributes))

    def as_dict(self) -> dict[str, DataFrame]:
        return {"entities": self.entities, "triples": self.triples, "pset_properties": self.properties, "entity_attributes": self.attributes}

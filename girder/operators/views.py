"""Derived relations of a model: inherited properties, classifications, materials, documents.

Every view is a DataFrame plan keyed by ``model_id``, so one job covers all models. Overrides are anti joins, never
correlated subqueries, and walks are joins that stop at a fixed depth.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN_DEPTH = 8
SET_OF_USAGE = ("hasMaterialLayerSet", "hasMaterialProfileSet")
MEMBER_OF_SET = ("hasMaterialLayer", "hasMaterialConstituent", "hasMaterialProfile", "hasMaterial")


def edges(triples: DataFrame, *predicates: str, subject: str = "subject", target: str = "object") -> DataFrame:
    """(model_id, subject, target) of the edges with one of the predicates, renamed."""
    return triples.where(F.col("predicate").isin(*predicates)).select("model_id", F.col("subject").alias(subject), F.col("object").alias(target))


def ifc_class(column: str = "ifc_type") -> Column:
    return F.upper(F.col(column))


class Views:
    """Lazily built views over one :class:`girder.schema.ModelTables`."""

    def __init__(self, tables):
        self.tables = tables

    @cached_property
    def types(self) -> DataFrame:
        """(model_id, type_id, entity_id) of occurrences and their types."""
        return edges(self.tables.triples, "IfcRelDefinesByType", subject="type_id", target="entity_id")

    @cached_property
    def effective_properties(self) -> DataFrame:
        """Own property rows, and those of the type for property sets that the occurrence lacks."""
        own = self.tables.properties
        of_type = self.types.join(own.withColumnRenamed("entity_id", "type_id"), ["model_id", "type_id"]).drop("type_id")
        names = own.select("model_id", "entity_id", "pset_name").distinct()
        inherited = of_type.join(names, ["model_id", "entity_id", "pset_name"], "left_anti")
        return own.unionByName(inherited.select(*own.columns))

    @cached_property
    def classification_chain(self) -> DataFrame:
        """(model_id, ref_id, node_id): a classification node and the nodes above it, itself included, each once."""
        up = edges(self.tables.triples, "hasClassificationReference", subject="parent", target="child").distinct()
        walk = self.tables.entities.where(ifc_class().isin("IFCCLASSIFICATION", "IFCCLASSIFICATIONREFERENCE")).select("model_id", F.col("entity_id").alias("ref_id"), F.col("entity_id").alias("n0"))
        for k in range(CHAIN_DEPTH):
            walk = walk.join(up.select("model_id", F.col("child").alias(f"n{k}"), F.col("parent").alias(f"n{k + 1}")), ["model_id", f"n{k}"], "left")
        nodes = F.explode(F.array_compact(F.array(*[f"n{k}" for k in range(CHAIN_DEPTH + 1)])))
        return walk.select("model_id", "ref_id", nodes.alias("node_id")).distinct()

    @cached_property
    def classification_codes(self) -> DataFrame:
        """(model_id, ref_id, system, code): the root's name and the identifications on the way there."""
        nodes = self.tables.entities.select("model_id", F.col("entity_id").alias("node_id"), "name", "identification", ifc_class().alias("kind"))
        walked = self.classification_chain.join(nodes, ["model_id", "node_id"])
        root = F.when(F.col("kind") == "IFCCLASSIFICATION", F.coalesce("name", F.lit("")))
        walked = walked.withColumn("system", F.max(root).over(Window.partitionBy("model_id", "ref_id")))  # a chain has few nodes
        is_reference = F.col("kind") == "IFCCLASSIFICATIONREFERENCE"
        named = walked.where(is_reference | (F.col("node_id") == F.col("ref_id")))
        return named.select("model_id", "ref_id", F.coalesce("system", F.lit("")).alias("system"), F.when(is_reference, F.col("identification")).alias("code")).distinct()

    @cached_property
    def classifications(self) -> DataFrame:
        """(model_id, entity_id, system, code): own ones, and the type's in systems that the occurrence lacks."""
        own = edges(self.tables.triples, "IfcRelAssociatesClassification", subject="entity_id", target="ref_id").join(self.classification_codes, ["model_id", "ref_id"])
        own = own.select("model_id", "entity_id", "system", "code")
        of_type = self.types.join(own.withColumnRenamed("entity_id", "type_id"), ["model_id", "type_id"]).drop("type_id")
        inherited = of_type.join(own.select("model_id", "entity_id", "system").distinct(), ["model_id", "entity_id", "system"], "left_anti")
        return own.unionByName(inherited.select(*own.columns)).distinct()

    @cached_property
    def materials(self) -> DataFrame:
        """(model_id, entity_id, material_entity_id, name, category) of every material node that an element reaches."""
        triples = self.tables.triples
        own = edges(triples, "IfcRelAssociatesMaterial", subject="entity_id", target="node")
        of_type = self.types.join(own.withColumnRenamed("entity_id", "type_id"), ["model_id", "type_id"]).select("model_id", "entity_id", "node")
        given = own.unionByName(of_type.join(own.select("model_id", "entity_id").distinct(), ["model_id", "entity_id"], "left_anti")).distinct()
        usage = edges(triples, *SET_OF_USAGE, subject="node", target="set_id")
        sets = given.join(usage, ["model_id", "node"], "left").select("model_id", "entity_id", F.coalesce("set_id", "node").alias("node"))
        members = sets.join(edges(triples, *MEMBER_OF_SET, subject="node", target="member"), ["model_id", "node"]).select("model_id", "entity_id", F.col("member").alias("node"))
        leaves = members.join(edges(triples, "hasMaterial", subject="node", target="leaf"), ["model_id", "node"]).select("model_id", "entity_id", F.col("leaf").alias("node"))
        reached = sets.unionByName(members).unionByName(leaves).distinct()
        lower = F.lower("attr_name")
        labels = (
            self.tables.attributes.where(lower.isin("name", "layersetname", "category"))
            .groupBy("model_id", F.col("entity_id").alias("node"))
            .agg(F.min(F.when(lower != "category", F.col("value"))).alias("label"), F.min(F.when(lower == "category", F.col("value"))).alias("category"))
        )
        nodes = self.tables.entities.select("model_id", F.col("entity_id").alias("node"), "name")
        joined = reached.join(nodes, ["model_id", "node"]).join(labels, ["model_id", "node"], "left")
        blank_as_null = lambda c: F.nullif(F.col(c), F.lit(""))
        return joined.select(
            "model_id", "entity_id", F.col("node").alias("material_entity_id"),
            F.coalesce(blank_as_null("label"), F.col("name")).alias("name"), blank_as_null("category").alias("category"),
        ).distinct()

    @cached_property
    def material_classifications(self) -> DataFrame:
        """(model_id, material_entity_id, system, code): materials and references that hang off the same relationship."""
        entities = self.tables.entities
        refs = entities.where(ifc_class().contains("CLASSIFICATION") & (F.col("name").isNotNull() | F.col("identification").isNotNull()))
        refs = refs.select("model_id", F.col("entity_id").alias("ref_id"), F.coalesce("name", F.lit("")).alias("system"), F.coalesce("identification", F.lit("")).alias("code"))
        materials = entities.where(ifc_class().contains("MATERIAL")).select("model_id", F.col("entity_id").alias("material_entity_id"))
        given = edges(self.tables.triples, "hasMaterialClassification", subject="node", target="ref_id").join(refs, ["model_id", "ref_id"])
        siblings = self.tables.triples.select("model_id", F.col("subject").alias("node"), F.col("object").alias("material_entity_id"))
        return given.join(siblings, ["model_id", "node"]).join(materials, ["model_id", "material_entity_id"]).select("model_id", "material_entity_id", "system", "code")

    @cached_property
    def documents(self) -> DataFrame:
        """(model_id, entity_id, title, location) of associated documents."""
        docs = self.tables.entities.where(ifc_class().contains("DOCUMENT"))
        docs = docs.select("model_id", F.col("entity_id").alias("doc_id"), F.col("name").alias("title"), F.col("identification").alias("location"))
        given = edges(self.tables.triples, "IfcRelAssociatesDocument", subject="entity_id", target="doc_id")
        return given.join(docs, ["model_id", "doc_id"]).select("model_id", "entity_id", "title", "location")

    @cached_property
    def predefined_types(self) -> DataFrame:
        """(model_id, entity_id, pt_enum, pt_user), each entity once: the predefined type that counts, and the user-defined text beside it.

        The type's value counts if it has one other than NOTDEFINED; of several types the least id is taken. Where rows share an id,
        those without a value do not count.
        """
        entities = self.tables.entities
        telling = entities.where(F.col("predefined_type").isNotNull() & (F.upper("predefined_type") != "NOTDEFINED"))
        telling = telling.select("model_id", F.col("entity_id").alias("type_id"), F.col("predefined_type").alias("type_enum"))
        chosen = self.types.join(telling, ["model_id", "type_id"]).groupBy("model_id", "entity_id").agg(F.min(F.struct("type_id", "type_enum")).alias("type"))
        own = entities.groupBy("model_id", "entity_id").agg(F.min("predefined_type").alias("own_enum"))
        source = own.join(chosen, ["model_id", "entity_id"], "left")
        source = source.select("model_id", "entity_id", F.coalesce("type.type_id", "entity_id").alias("source_id"), F.coalesce("type.type_enum", "own_enum").alias("pt_enum"))
        texts = self.tables.attributes.where(F.lower("attr_name").isin("objecttype", "elementtype", "processtype", "resourcetype") & (F.col("value") != ""))
        texts = texts.groupBy("model_id", F.col("entity_id").alias("source_id")).agg(F.min("value").alias("pt_user"))
        return source.join(texts, ["model_id", "source_id"], "left").select("model_id", "entity_id", "pt_enum", "pt_user")

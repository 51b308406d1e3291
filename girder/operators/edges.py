"""Edges of the model graph, from tables of rules that are joined with the records.

A rule says which arguments of a class hold the subject and the object of an edge. One table holds the rules of all kinds, so one
pass over the records, one broadcast join, one explode per side and two semi joins replace a handler per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.scratch import Scratch, growing
from girder.sources.geometry_classes import GEOMETRY_CLASSES, PLACEMENT_CLASSES
from girder.sources.step import list_refs, ref_id

# Class, predicate, argument of the subject and whether it is a list, the same of the object.
RELATIONSHIPS = (
    ("IFCRELAGGREGATES", "IfcRelAggregates", 4, False, 5, True),
    ("IFCRELCONTAINEDINSPATIALSTRUCTURE", "IfcRelContainedInSpatialStructure", 5, False, 4, True),
    ("IFCRELDEFINESBYPROPERTIES", "IfcRelDefinesByProperties", 4, True, 5, False),
    ("IFCRELDEFINESBYTYPE", "IfcRelDefinesByType", 5, False, 4, True),
    ("IFCRELVOIDSELEMENT", "IfcRelVoidsElement", 4, False, 5, False),
    ("IFCRELFILLSELEMENT", "IfcRelFillsElement", 4, False, 5, False),
    ("IFCRELCONNECTSELEMENTS", "IfcRelConnectsElements", 5, False, 6, False),
    ("IFCRELCONNECTSPATHELEMENTS", "IfcRelConnectsPathElements", 5, False, 6, False),
    ("IFCRELASSOCIATESCLASSIFICATION", "IfcRelAssociatesClassification", 4, True, 5, False),
    ("IFCEXTERNALREFERENCERELATIONSHIP", "IfcRelAssociatesClassification", 3, True, 2, False),
    ("IFCRELASSOCIATESDOCUMENT", "IfcRelAssociatesDocument", 4, True, 5, False),
    ("IFCRELASSOCIATESMATERIAL", "IfcRelAssociatesMaterial", 4, True, 5, False),
    ("IFCRELASSIGNSTOGROUP", "IfcRelAssignsToGroup", 6, False, 4, True),
    ("IFCRELSPACEBOUNDARY", "IfcRelSpaceBoundary", 4, False, 5, False),
    ("IFCRELSPACEBOUNDARY1STLEVEL", "IfcRelSpaceBoundary", 4, False, 5, False),
    ("IFCRELSPACEBOUNDARY2NDLEVEL", "IfcRelSpaceBoundary", 4, False, 5, False),
    ("IFCRELNESTS", "IfcRelNests", 4, False, 5, True),
    ("IFCRELDECLARES", "IfcRelDeclares", 4, False, 5, True),
    ("IFCRELDEFINESBYOBJECT", "IfcRelDefinesByObject", 5, False, 4, True),
    ("IFCRELDEFINESBYTEMPLATE", "IfcRelDefinesByTemplate", 5, False, 4, True),
    ("IFCRELASSIGNSTOACTOR", "IfcRelAssignsToActor", 6, False, 4, True),
    ("IFCRELASSIGNSTOCONTROL", "IfcRelAssignsToControl", 6, False, 4, True),
    ("IFCRELASSIGNSTOGROUPBYFACTOR", "IfcRelAssignsToGroup", 6, False, 4, True),
    ("IFCRELASSIGNSTOPROCESS", "IfcRelAssignsToProcess", 6, False, 4, True),
    ("IFCRELASSIGNSTOPRODUCT", "IfcRelAssignsToProduct", 6, False, 4, True),
    ("IFCRELASSIGNSTORESOURCE", "IfcRelAssignsToResource", 6, False, 4, True),
    ("IFCRELASSOCIATESAPPROVAL", "IfcRelAssociatesApproval", 4, True, 5, False),
    ("IFCRELASSOCIATESCONSTRAINT", "IfcRelAssociatesConstraint", 4, True, 6, False),
    ("IFCRELASSOCIATESLIBRARY", "IfcRelAssociatesLibrary", 4, True, 5, False),
    ("IFCRELASSOCIATESPROFILEDEF", "IfcRelAssociatesProfileDef", 4, True, 5, False),
    ("IFCRELADHERESTOELEMENT", "IfcRelAdheresToElement", 4, False, 5, True),
    ("IFCRELCOVERSBLDGELEMENTS", "IfcRelCoversBldgElements", 4, False, 5, True),
    ("IFCRELCOVERSSPACES", "IfcRelCoversSpaces", 4, False, 5, True),
    ("IFCRELPROJECTSELEMENT", "IfcRelProjectsElement", 4, False, 5, False),
    ("IFCRELCONNECTSPORTTOELEMENT", "IfcRelConnectsPortToElement", 4, False, 5, False),
    ("IFCRELCONNECTSPORTS", "IfcRelConnectsPorts", 4, False, 5, False),
    ("IFCRELCONNECTSSTRUCTURALACTIVITY", "IfcRelConnectsStructuralActivity", 4, False, 5, False),
    ("IFCRELCONNECTSSTRUCTURALMEMBER", "IfcRelConnectsStructuralMember", 4, False, 5, False),
    ("IFCRELCONNECTSWITHECCENTRICITY", "IfcRelConnectsStructuralMember", 4, False, 5, False),
    ("IFCRELCONNECTSWITHREALIZINGELEMENTS", "IfcRelConnectsElements", 5, False, 6, False),
    ("IFCRELINTERFERESELEMENTS", "IfcRelInterferesElements", 4, False, 5, False),
    ("IFCRELFLOWCONTROLELEMENTS", "IfcRelFlowControlElements", 5, False, 4, True),
    ("IFCRELSEQUENCE", "IfcRelSequence", 4, False, 5, False),
    ("IFCRELSERVICESBUILDINGS", "IfcRelServicesBuildings", 4, False, 5, True),
    ("IFCRELREFERENCEDINSPATIALSTRUCTURE", "IfcRelReferencedInSpatialStructure", 5, False, 4, True),
    ("IFCRELPOSITIONS", "IfcRelPositions", 4, False, 5, True),
)

# Class, argument, whether it is a list, predicate; the record itself is the subject.
SYNTHETIC = (
    ("IFCMATERIALCONSTITUENTSET", 2, True, "hasMaterialConstituent"),
    ("IFCMATERIALLAYERSET", 0, True, "hasMaterialLayer"),
    ("IFCMATERIALPROFILESET", 2, True, "hasMaterialProfile"),
    ("IFCMATERIALLIST", 0, True, "hasMaterial"),
    ("IFCMATERIALCONSTITUENT", 2, False, "hasMaterial"),
    ("IFCMATERIALLAYER", 0, False, "hasMaterial"),
    ("IFCMATERIALPROFILE", 2, False, "hasMaterial"),
    ("IFCMATERIALLAYERWITHOFFSETS", 0, False, "hasMaterial"),
    ("IFCMATERIALPROFILEWITHOFFSETS", 2, False, "hasMaterial"),
    ("IFCMATERIALLAYERSETUSAGE", 0, False, "hasMaterialLayerSet"),
    ("IFCMATERIALPROFILESETUSAGE", 0, False, "hasMaterialProfileSet"),
    ("IFCMATERIALCLASSIFICATIONRELATIONSHIP", 0, True, "hasMaterialClassification"),
    ("IFCEXTERNALREFERENCERELATIONSHIP", 2, False, "hasMaterialClassification"),
    ("IFCPROPERTYSET", 4, True, "hasProperty"),
    ("IFCELEMENTQUANTITY", 5, True, "hasQuantity"),
    ("IFCPROPERTYSETTEMPLATE", 6, True, "hasTemplate"),
    ("IFCCOMPLEXPROPERTY", 3, True, "hasProperty"),
    ("IFCAPPROVALRELATIONSHIP", 2, False, "relatedApproval"),
    ("IFCAPPROVALRELATIONSHIP", 3, False, "relatingApproval"),
)

# The predicates that each use of a model keeps; learning keeps all.
PROFILES: dict[str, tuple[str, ...] | None] = {
    "learning": None,
    "asset-management": (
        "IfcRelAggregates", "IfcRelNests", "IfcRelContainedInSpatialStructure", "IfcRelReferencedInSpatialStructure", "IfcRelDefinesByType",
        "IfcRelDefinesByProperties", "IfcRelAssociatesMaterial", "IfcRelAssociatesClassification", "IfcRelAssociatesDocument", "IfcRelDeclares",
        "hasProperty", "hasQuantity", "hasMaterial", "hasMaterialLayer", "hasMaterialLayerSet", "hasMaterialProfileSet", "hasMaterialConstituent",
        "hasMaterialProfile", "hasClassificationReference",
    ),
    "qto": ("IfcRelAggregates", "IfcRelContainedInSpatialStructure", "IfcRelDefinesByType", "IfcRelDefinesByProperties", "hasQuantity"),
    "bcf-ids": ("IfcRelAggregates", "IfcRelNests", "IfcRelContainedInSpatialStructure", "IfcRelDefinesByType", "IfcRelDeclares"),
    "coordination": (
        "IfcRelAggregates", "IfcRelNests", "IfcRelContainedInSpatialStructure", "IfcRelReferencedInSpatialStructure", "IfcRelVoidsElement",
        "IfcRelFillsElement", "IfcRelConnectsElements", "IfcRelConnectsPathElements", "IfcRelConnectsPorts", "IfcRelConnectsPortToElement",
        "IfcRelInterferesElements", "IfcRelProjectsElement", "IfcRelAdheresToElement", "IfcRelSpaceBoundary", "IfcRelDefinesByType",
    ),
}

EDGE = ["model_id", "subject", "predicate", "object"]


def edges_of(triples: DataFrame, *predicates: str) -> DataFrame:
    return triples.where(F.col("predicate").isin(*predicates))


def is_relationship() -> Column:
    return F.startswith("ifc_type", F.lit("IFCREL"))


def is_geometry() -> Column:
    return F.col("ifc_type").isin(*GEOMETRY_CLASSES, *PLACEMENT_CLASSES)


def is_type() -> Column:
    return ~is_relationship() & (F.endswith("ifc_type", F.lit("TYPE")) | F.col("ifc_type").isin("IFCDOORSTYLE", "IFCWINDOWSTYLE"))


def kept_records(records: DataFrame) -> DataFrame:
    """Records that are nodes of the graph."""
    return records.where(~is_geometry() & ~is_relationship())


#: Argument that stands for the record itself, and the class that stands for all type classes.
SELF, ANY_TYPE = -1, "*"
_RULE = "rule_type string, predicate string, from_arg int, from_many boolean, to_arg int, to_many boolean, origin string"
CLASSIFICATION = (("IFCCLASSIFICATIONREFERENCE", "hasClassificationReference", 3, False, SELF, False, "classification"),)
TYPE_SETS = ((ANY_TYPE, "hasPropertySet", SELF, False, 5, True, "type"),)
RULES = (
    *((*rule, "relationship") for rule in RELATIONSHIPS),
    *((kind, predicate, SELF, False, argument, many, "synthetic") for kind, argument, many, predicate in SYNTHETIC),
    *CLASSIFICATION,
    *TYPE_SETS,
)


def _side(argument: str, many: str) -> Column:
    """Ids of one side of a rule: the record itself, the list's references, or the single one."""
    text = F.get(F.col("arg_list"), F.col(argument))
    single = ref_id(text)
    return F.when(F.col(argument) == SELF, F.array("entity_id")).when(F.col(many), list_refs(text)).when(single.isNotNull(), F.array(single))


def ruled_edges(records: DataFrame, *origins: str) -> DataFrame:
    """Edges by the rules of the given origins (all by default), before their ends are checked."""
    rules = [rule for rule in RULES if not origins or rule[-1] in origins]
    table = records.sparkSession.createDataFrame(rules, _RULE)  # a table of constants
    classes = sorted({rule[0] for rule in rules})
    rows = records.withColumn("rule_type", F.when(is_type(), ANY_TYPE).otherwise(F.col("ifc_type"))).where(F.col("rule_type").isin(classes))
    rows = rows.select("model_id", "entity_id", "rule_type", "arg_list").join(F.broadcast(table), "rule_type")
    rows = rows.withColumn("subject", F.explode(_side("from_arg", "from_many")))
    return rows.withColumn("object", F.explode(_side("to_arg", "to_many"))).select(*EDGE)


def relationship_edges(records: DataFrame) -> DataFrame:
    return ruled_edges(records, "relationship")


def synthetic_edges(records: DataFrame) -> DataFrame:
    return ruled_edges(records, "synthetic")


def type_property_edges(records: DataFrame) -> DataFrame:
    return ruled_edges(records, "type")


def between_kept(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends are kept."""
    ids = kept.select("model_id", "entity_id")
    at_subject = edges.join(growing(ids.withColumnRenamed("entity_id", "subject")), ["model_id", "subject"], "left_semi")
    return at_subject.join(growing(ids.withColumnRenamed("entity_id", "object")), ["model_id", "object"], "left_semi").select(*edges.columns)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]


def generic_edges(records: DataFrame, named: DataFrame) -> DataFrame:
    """``references`` edges for pairs that no named edge joins, in either direction; the first mention in file order counts."""
    kept = kept_records(records)
    args = kept.select("model_id", F.col("entity_id").alias("subject"), "ord", F.posexplode(F.filter("arg_list", lambda x: F.contains(x, F.lit("#")))).alias("arg", "text"))
    refs = args.select("model_id", "subject", "ord", "arg", F.posexplode(list_refs(F.col("text"))).alias("at", "object")).where("subject != object")
    refs = between_kept(refs, kept).select("*", *_pair("subject", "object"))
    linked = named.select("model_id", *_pair("subject", "object")).distinct()
    free = refs.join(growing(linked), ["model_id", "low", "high"], "left_anti")
    first = free.groupBy("model_id", "low", "high").agg(F.min(F.struct("ord", "arg", "at", "subject", "object")).alias("e"))
    return first.select("model_id", F.col("e.subject").alias("subject"), F.lit("references").alias("predicate"), F.col("e.object").alias("object"))


def named_edges(records: DataFrame) -> DataFrame:
    return between_kept(ruled_edges(records), kept_records(records))


def extract_edges(records: DataFrame, profile: str = "learning") -> DataFrame:
    """All edges of the models, cut to a profile's predicates. Records are parsed once: they are written first."""
    scratch = Scratch(records.sparkSession, "edges")
    return edges_of_written(scratch.save(records, "records"), scratch, profile)


def edges_of_written(records: DataFrame, scratch: Scratch, profile: str = "learning") -> DataFrame:
    """The same for records that are read from files."""
    named = scratch.save(named_edges(records), "named")
    return filter_profile(named.unionByName(generic_edges(records, named)), profile)


def filter_profile(edges: DataFrame, profile: str) -> DataFrame:
    allowed = PROFILES[profile]
    return edges if allowed is None else edges.where(F.col("predicate").isin(*allowed))


def mesh_statistics(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """Box and counts per element, from vertices (model_id, entity_id, x, y, z, m array of 16, column-major) and mesh parts
    (model_id, entity_id, geometry_id, n_vertices, n_triangles)."""
    m = lambda k: F.get("m", F.lit(k))
    world = [m(k) * F.col("x") + m(k + 4) * F.col("y") + m(k + 8) * F.col("z") + m(k + 12) for k in range(3)]
    boxes = vertices.groupBy("model_id", "entity_id").agg(
        *[F.min(w).alias(f"bbox_min_{a}") for w, a in zip(world, "xyz", strict=True)], *[F.max(w).alias(f"bbox_max_{a}") for w, a in zip(world, "xyz", strict=True)]
    )
    per_geometry = parts.groupBy("model_id", "entity_id", "geometry_id").agg(
        F.sum("n_vertices").alias("v"), F.sum("n_triangles").alias("t"), F.max("n_vertices").alias("u"), F.count("*").alias("p")
    )
    counts = per_geometry.groupBy("model_id", "entity_id").agg(
        F.sum("v").cast("int").alias("vertex_count"), F.sum("t").cast("int").alias("triangle_count"), F.sum("u").cast("int").alias("unique_vertex_count"), F.sum("p").cast("int").alias("mesh_part_count")
    )
    return counts.join(boxes, ["model_id", "entity_id"], "full")


def placement_points(records: DataFrame) -> DataFrame:
    """(model_id, placement_id, x, y, z) of local placements: placement to axes to point."""
    axes = records.where("ifc_type = 'IFCLOCALPLACEMENT'").select("model_id", F.col("entity_id").alias("placement_id"), ref_id(F.get("arg_list", F.lit(1))).alias("axis"))
    points = records.where("ifc_type = 'IFCAXIS2PLACEMENT3D'").select("model_id", F.col("entity_id").alias("axis"), ref_id(F.get("arg_list", F.lit(0))).alias("point"))
    xyz = F.transform(F.split(F.regexp_replace(F.get("arg_list", F.lit(0)), "[() ]", ""), ","), lambda t: t.try_cast("double"))
    spots = records.where("ifc_type = 'IFCCARTESIANPOINT'").select("model_id", F.col("entity_id").alias("point"), xyz.alias("c"))
    found = axes.join(points, ["model_id", "axis"]).join(spots, ["model_id", "point"])
    return found.select("model_id", "placement_id", *[F.coalesce(F.get("c", F.lit(k)), F.lit(0.0)).alias(a) for k, a in enumerate("xyz")])

"""The star-schema test tables seen as one building model.

The SQL below is plain enough for Spark and DuckDB alike, so that the same mapping feeds the DataFrame engine and
the SQL that its results are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girder.schema import ATTRIBUTES, ENTITIES, PROPERTIES, TRIPLES, ModelTables

_NO_BOX = ", ".join(f"CAST(NULL AS DOUBLE) AS bbox_{m}_{a}" for m in ("min", "max") for a in "xyz")
_NO_MESH = ", ".join(f"CAST(NULL AS INT) AS {c}" for c in ("vertex_count", "triangle_count", "unique_vertex_count", "mesh_part_count"))


def _entity(source: str, number: str, kind: str, **columns: str) -> str:
    text = ("name", "global_id", "global_id_canonical", "description", "object_type", "tag", "predefined_type", "long_name", "identification", "empty_attrs")
    given = ", ".join(f"CAST({columns.get(c, 'NULL')} AS VARCHAR(4000)) AS {c}" for c in text)
    box = columns.get("box", _NO_BOX)
    return f"SELECT 'm' AS model_id, CAST({number} AS INT) AS entity_id, '{kind}' AS ifc_type, {given}, {box}, {_NO_MESH} FROM {source}"


_CUSTOMER_BOX = ", ".join(f"CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {v} END AS DOUBLE) AS bbox_{c}" for c, v in (("min_x", "c_custkey"), ("min_y", "c_custkey * 2"), ("min_z", "c_custkey * 3"), ("max_x", "c_custkey + 1"), ("max_y", "c_custkey * 2 + 1"), ("max_z", "c_custkey * 3 + 1")))

ENTITIES_SQL = " UNION ALL ".join(
    [
        _entity("region", "100 + r_regionkey", "IFCSITE", name="r_name"),
        _entity("nation", "1000 + n_nationkey", "IFCBUILDING", name="n_name"),
        _entity("region", "2000 + r_regionkey", "IFCCLASSIFICATION", name="r_name"),
        _entity("nation", "3000 + n_nationkey", "IFCCLASSIFICATIONREFERENCE", name="n_name", identification="concat('N-', CAST(n_nationkey AS VARCHAR(20)))"),
        _entity("nation", "4000 + n_nationkey", "IFCDOCUMENTREFERENCE", name="concat('Doc ', n_name)", identification="concat('loc/', CAST(n_regionkey AS VARCHAR(20)))"),
        _entity("nation", "5000 + n_nationkey", "IFCMATERIALCLASSIFICATIONRELATIONSHIP"),
        _entity("supplier", "100000 + s_suppkey", "IFCMATERIALLAYERSET"),
        _entity("part", "1000000 + p_partkey", "IFCMATERIAL", name="p_name"),
        _entity("region WHERE r_regionkey < 2", "10 + r_regionkey", "IFCPROJECT", name="concat('Project ', r_name)", long_name="r_name"),
        _entity(
            "customer", "2000000 + c_custkey", "IFCDOORTYPE", name="c_name", box=_CUSTOMER_BOX,
            predefined_type="CASE c_mktsegment WHEN 'BUILDING' THEN 'DOOR' WHEN 'AUTOMOBILE' THEN 'GATE' WHEN 'FURNITURE' THEN 'USERDEFINED' WHEN 'HOUSEHOLD' THEN 'NOTDEFINED' END",
        ),
        _entity(
            "orders", "10000000 + o_orderkey", "IFCDOOR", name="concat('Order#', CAST(o_orderkey AS VARCHAR(20)))",
            description="CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END", object_type="o_orderpriority",
            predefined_type="CASE o_orderstatus WHEN 'O' THEN 'NOTDEFINED' WHEN 'F' THEN 'TRAPDOOR' ELSE 'USERDEFINED' END",
            empty_attrs="CASE WHEN o_orderkey % 14 = 0 THEN ',description,' END",
        ),
    ]
)


def _edge(source: str, subject: str, predicate: str, target: str) -> str:
    return f"SELECT 'm' AS model_id, CAST({subject} AS INT) AS subject, '{predicate}' AS predicate, CAST({target} AS INT) AS object FROM {source}"


TRIPLES_SQL = " UNION ALL ".join(
    [
        _edge("nation", "100 + n_regionkey", "IfcRelAggregates", "1000 + n_nationkey"),
        _edge("customer", "1000 + c_nationkey", "IfcRelAggregates", "2000000 + c_custkey"),
        _edge("orders", "2000000 + o_custkey", "IfcRelNests", "10000000 + o_orderkey"),
        _edge("orders", "2000000 + o_custkey", "IfcRelDefinesByType", "10000000 + o_orderkey"),
        _edge("nation", "2000 + n_regionkey", "hasClassificationReference", "3000 + n_nationkey"),
        _edge("orders WHERE o_orderkey % 3 = 0", "10000000 + o_orderkey", "IfcRelAssociatesClassification", "3000 + o_orderkey % 25"),
        _edge("customer", "2000000 + c_custkey", "IfcRelAssociatesClassification", "3000 + c_nationkey"),
        _edge("orders WHERE o_orderkey % 5 = 0", "10000000 + o_orderkey", "IfcRelAssociatesMaterial", "100000 + o_orderkey % 10"),
        _edge("customer WHERE c_custkey % 2 = 0", "2000000 + c_custkey", "IfcRelAssociatesMaterial", "100000 + c_custkey % 10"),
        _edge("part WHERE p_partkey % 20 < 4", "100000 + floor(p_partkey / 20)", "hasMaterialLayer", "1000000 + p_partkey"),
        _edge("orders WHERE o_orderkey % 11 = 0", "10000000 + o_orderkey", "IfcRelAssociatesDocument", "4000 + o_orderkey % 25"),
        _edge("nation", "5000 + n_nationkey", "hasMaterialClassification", "3000 + n_nationkey"),
        _edge("nation", "5000 + n_nationkey", "references", "1000000 + n_nationkey"),
    ]
)


def _property(source: str, number: str, pset: str, name: str, value: str, kind: str, num: str = "NULL", si: str = "NULL", unit: str = "NULL") -> str:
    return (
        f"SELECT 'm' AS model_id, CAST({number} AS INT) AS entity_id, {pset} AS pset_name, '{name}' AS property_name, {value} AS value, "
        f"CAST({num} AS DOUBLE) AS value_num, CAST({si} AS DOUBLE) AS value_si, CAST({unit} AS VARCHAR(40)) AS unit, '{kind}' AS data_type FROM {source}"
    )


_LINE = "concat('Pset_Line', CAST(l_linenumber AS VARCHAR(20)))"
PROPERTIES_SQL = " UNION ALL ".join(
    [
        _property("lineitem", "10000000 + l_orderkey", _LINE, "Quantity", "CAST(CAST(l_quantity AS INT) AS VARCHAR(20))", "IFCLENGTHMEASURE", "l_quantity", "l_quantity / 1000", "'MILLIMETRE'"),
        _property("lineitem", "10000000 + l_orderkey", _LINE, "ReturnFlag", "l_returnflag", "IFCLABEL"),
        _property("customer", "2000000 + c_custkey", "'Pset_Common'", "Segment", "c_mktsegment", "IFCLABEL"),
        _property("customer", "2000000 + c_custkey", "'Pset_Common'", "Approved", "CASE WHEN c_acctbal > 0 THEN 'TRUE' END", "IFCBOOLEAN"),
        _property("customer", "2000000 + c_custkey", "'Pset_Line1'", "Quantity", "CAST(c_custkey % 50 AS VARCHAR(20))", "IFCLENGTHMEASURE", "c_custkey % 50", "CAST(c_custkey % 50 AS DOUBLE) / 1000", "'MILLIMETRE'"),
        _property("orders WHERE o_orderkey % 4 = 0", "10000000 + o_orderkey", "'Pset_Common'", "Segment", "'OVERRIDE'", "IFCLABEL"),
    ]
)


def _attribute(source: str, number: str, name: str, value: str) -> str:
    return f"SELECT 'm' AS model_id, CAST({number} AS INT) AS entity_id, '{name}' AS attr_name, {value} AS value FROM {source}"


ATTRIBUTES_SQL = " UNION ALL ".join(
    [
        _attribute("supplier", "100000 + s_suppkey", "LayerSetName", "s_name"),
        _attribute("part", "1000000 + p_partkey", "Name", "p_name"),
        _attribute("part", "1000000 + p_partkey", "Category", "p_type"),
        _attribute("customer", "2000000 + c_custkey", "ElementType", "c_mktsegment"),
        _attribute("orders", "10000000 + o_orderkey", "ObjectType", "o_orderpriority"),
        _attribute("orders", "10000000 + o_orderkey", "OverallHeight", "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(o_orderkey % 100 AS VARCHAR(20)) END"),
        _attribute("events", "200000000 + event_id", "EventType", "event_type"),
    ]
)

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _frame(spark: SparkSession, sf_dir: str, sql: str, schema) -> DataFrame:
    """The mapping's query over the tables of ``sf_dir``, with columns of the engine's types."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if f" {t}" in sql}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    made = spark.sql(sql, **tables)
    return made.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def star_model(spark: SparkSession, sf_dir: str) -> ModelTables:
    return ModelTables(
        _frame(spark, sf_dir, ENTITIES_SQL, ENTITIES),
        _frame(spark, sf_dir, TRIPLES_SQL, TRIPLES),
        _frame(spark, sf_dir, PROPERTIES_SQL, PROPERTIES),
        _frame(spark, sf_dir, ATTRIBUTES_SQL, ATTRIBUTES),
    )


#: Common table expressions for the SQL that results are held against.
ORACLE_BASE = f"entities AS ({ENTITIES_SQL}), triples AS ({TRIPLES_SQL}), pset_properties AS ({PROPERTIES_SQL}), entity_attributes AS ({ATTRIBUTES_SQL})"

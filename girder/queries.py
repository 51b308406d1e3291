"""Registered queries of the checking engine over the star tables, each with the SQL that its rows are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import guid, units
from girder.functions.numbers import interval, number, script_number
from girder.mapping import ORACLE_BASE, star_model
from girder.operators import edges, ingest, lookup, report
from girder.plans.evaluate import cardinality, evaluate_spec, spec_frame, verdict
from girder.plans.facets import Ask, FacetPlanner
from girder.plans.restrictions import matches, matches_measure
from girder.plans.rules import Attribute, Bounds, Classification, Entity, Facet, Length, Material, OneOf, PartOf, Pattern, Property, Requirement, Simple, Specification
from girder.sources import step

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COPIED = "model_id, entity_id, pset_name, property_name, value, value_num, value_si, unit, data_type"
VIEWS_SQL = f"""
types AS (SELECT model_id, subject AS type_id, object AS entity_id FROM triples WHERE predicate = 'IfcRelDefinesByType'),
effective AS (
  SELECT {COPIED} FROM pset_properties
  UNION ALL
  SELECT t.model_id, t.entity_id, p.pset_name, p.property_name, p.value, p.value_num, p.value_si, p.unit, p.data_type
  FROM types t JOIN pset_properties p ON p.entity_id = t.type_id
  WHERE (t.entity_id, p.pset_name) NOT IN (SELECT entity_id, pset_name FROM pset_properties)
),
chain AS (
  SELECT model_id, entity_id AS ref_id, entity_id AS node_id, 0 AS steps FROM entities WHERE ifc_type IN ('IFCCLASSIFICATION', 'IFCCLASSIFICATIONREFERENCE')
  UNION ALL
  SELECT c.model_id, c.ref_id, t.subject, c.steps + 1 FROM chain c JOIN triples t ON t.object = c.node_id AND t.predicate = 'hasClassificationReference' WHERE c.steps < 8
),
systems AS (SELECT c.ref_id, max(coalesce(e.name, '')) AS system FROM chain c JOIN entities e ON e.entity_id = c.node_id WHERE e.ifc_type = 'IFCCLASSIFICATION' GROUP BY c.ref_id),
codes AS (
  SELECT DISTINCT c.model_id, c.ref_id, coalesce(s.system, '') AS system, CASE e.ifc_type WHEN 'IFCCLASSIFICATIONREFERENCE' THEN e.identification END AS code
  FROM chain c JOIN entities e ON e.entity_id = c.node_id LEFT JOIN systems s ON s.ref_id = c.ref_id
  WHERE e.ifc_type = 'IFCCLASSIFICATIONREFERENCE' OR c.node_id = c.ref_id
),
own_classes AS (SELECT t.model_id, t.subject AS entity_id, c.system, c.code FROM triples t JOIN codes c ON c.ref_id = t.object WHERE t.predicate = 'IfcRelAssociatesClassification'),
classes AS (
  SELECT * FROM own_classes
  UNION
  SELECT t.model_id, t.entity_id, o.system, o.code FROM types t JOIN own_classes o ON o.entity_id = t.type_id
  WHERE (t.entity_id, o.system) NOT IN (SELECT entity_id, system FROM own_classes)
),
own_material AS (SELECT model_id, subject AS entity_id, object AS node FROM triples WHERE predicate = 'IfcRelAssociatesMaterial'),
given_material AS (
  SELECT * FROM own_material
  UNION
  SELECT t.model_id, t.entity_id, o.node FROM types t JOIN own_material o ON o.entity_id = t.type_id WHERE t.entity_id NOT IN (SELECT entity_id FROM own_material)
),
reached AS (
  SELECT * FROM given_material
  UNION
  SELECT g.model_id, g.entity_id, t.object FROM given_material g JOIN triples t ON t.subject = g.node AND t.predicate = 'hasMaterialLayer'
),
labels AS (SELECT entity_id, max(CASE WHEN attr_name IN ('Name', 'LayerSetName') THEN value END) AS label, max(CASE WHEN attr_name = 'Category' THEN value END) AS category FROM entity_attributes GROUP BY entity_id),
stuff AS (
  SELECT DISTINCT r.model_id, r.entity_id, r.node AS material_entity_id, coalesce(l.label, e.name) AS name, l.category
  FROM reached r JOIN entities e ON e.entity_id = r.node LEFT JOIN labels l ON l.entity_id = r.node
),
doors AS (SELECT * FROM entities WHERE ifc_type = 'IFCDOOR')
"""
_NUM = r"regexp_full_match({0}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"


def sql_number(column: str) -> str:
    return f"CASE WHEN {_NUM.format(column)} THEN TRY_CAST({column} AS DOUBLE) END"


def with_model(select: str) -> str:
    return f"WITH RECURSIVE {ORACLE_BASE.replace(' AS (SELECT', ' AS MATERIALIZED (SELECT')}, {VIEWS_SQL} {select}"


def register(name: str, oracle: str | None = None, model: bool = False):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = with_model(oracle) if model else oracle
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOOR = Entity(Simple("IFCDOOR"))
QUANTITY = Property(Pattern("Pset_Line.*"), Simple("Quantity"), Bounds(low=0.010, low_included=True), "IFCLENGTHMEASURE")


def door_spec(*requirements: Requirement | Facet, cardinality: str = "required", applicability=(DOOR,)) -> Specification:
    wrapped = tuple(r if isinstance(r, Requirement) else Requirement(r) for r in requirements)
    return Specification("spec-0", "Doors", applicability, wrapped, cardinality)


# Flagship


@register(
    "flagship_quantity_rule",
    """SELECT d.entity_id, d.name, coalesce(f.ok, false) AS passed FROM doors d LEFT JOIN (
      SELECT entity_id, bool_and(has_name AND fine) AS ok FROM (
        SELECT entity_id, pset_name, bool_or(named) AS has_name, bool_and(NOT named OR ok) AS fine FROM (
          SELECT entity_id, pset_name, property_name, property_name = 'Quantity' AS named,
            bool_or(coalesce((data_type IS NULL OR upper(data_type) = 'IFCLENGTHMEASURE') AND value_si >= 0.01, false)) AS ok
          FROM effective WHERE pset_name LIKE 'Pset_Line%' GROUP BY entity_id, pset_name, property_name
        ) GROUP BY entity_id, pset_name) GROUP BY entity_id) f ON f.entity_id = d.entity_id""",
    model=True,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every door needs a quantity of 0.010 m or more in each of its line property sets."""
    frame = spec_frame(star_model(spark, sf_dir), door_spec(QUANTITY))
    return frame.select("entity_id", "name", F.col("req0").alias("passed"))


# Restrictions


def restricted(name: str, source: str, key: str, column: str, restriction, oracle: str, numeric: str | None = None) -> None:
    @register(name, f"SELECT {key}, coalesce({oracle}, false) AS ok FROM {source}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        made = rows.select(F.col(key), F.expr(column).alias("v"), (F.expr(numeric) if numeric else F.lit(None)).alias("n"))
        return made.select(key, F.coalesce(matches(F.col("v"), restriction, F.col("n") if numeric else None), F.lit(False)).alias("ok"))


_LOW, _HIGH = interval(42.0, True)
_SQL_QTY = "CAST(CAST(l_quantity AS INT) AS VARCHAR)"
restricted("restriction_present", "orders", "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END", None, "o_orderkey % 7 <> 0")
restricted("restriction_text", "customer", "c_custkey", "c_mktsegment", Simple("BUILDING"), "c_mktsegment = 'BUILDING'")
restricted("restriction_bool", "customer", "c_custkey", "CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'False' END", Simple("true"), "c_acctbal > 0")
restricted("restriction_numeric_tolerance", "orders", "o_orderkey", "concat(cast(o_orderkey % 50 as string), CASE WHEN o_orderkey % 2 = 0 THEN '.00001' ELSE '.' END)", Simple("42"), f"CAST(concat(CAST(o_orderkey % 50 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN '.00001' ELSE '.' END) AS DOUBLE) BETWEEN {_LOW!r} AND {_HIGH!r}")
restricted("restriction_enumeration", "orders", "o_orderkey", "o_orderpriority", OneOf(("1-URGENT", "5-LOW", "7")), "o_orderpriority IN ('1-URGENT', '5-LOW')")
restricted("restriction_pattern", "pages", "page_id", "url", Pattern(r"https?://[a-z]+\.example\.(com|org)/.*"), r"regexp_full_match(url, 'https?://[a-z]+\.example\.(com|org)/.*')")
restricted("restriction_pattern_subtraction", "part", "p_partkey", "p_name", Pattern(r"[\p{L}\p{N}\s#-[aeiou]]+"), r"regexp_full_match(p_name, '[\p{L}\p{N}\t\n\f\r #]+') AND NOT regexp_matches(p_name, '[aeiou]')")
restricted("restriction_length", "documents", "doc_id", "text", Length(least=200, most=1500), "length(text) BETWEEN 200 AND 1500")
restricted("restriction_length_exact", "events", "event_id", "event_type", Length(exact=5), "length(event_type) = 5")
restricted("restriction_bounds", "orders", "o_orderkey", "CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE cast(o_orderkey % 100 as string) END", Bounds(10, 20, False, True), "o_orderkey % 9 <> 0 AND o_orderkey % 100 > 10 AND o_orderkey % 100 <= 20")


@register(
    "restriction_measure",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 1000 BETWEEN {interval(0.025, False)[0]!r} AND {interval(0.025, False)[1]!r} AS equal,
          l_quantity / 1000 >= 0.01 AND l_quantity / 1000 < 0.02 AS bounded, l_quantity IN (10, 50) AS listed, false AS like_text FROM lineitem""",
)
def restriction_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in SI units against every kind of restriction; text is not matched with measures."""
    rows = table(spark, sf_dir, "lineitem").withColumn("si", F.col("l_quantity") / 1000)
    wanted = {"equal": Simple("0.025"), "bounded": Bounds(0.01, 0.02, True, False), "listed": OneOf(("0.01", "0.05")), "like_text": Pattern("0.*")}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.coalesce(matches_measure(F.col("si"), r), F.lit(False)).alias(n) for n, r in wanted.items()])


# Views


def view(name: str, attribute: str, columns: str, oracle: str) -> None:
    @register(f"view_{name}", f"SELECT {columns} FROM {oracle}", model=True)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(star_model(spark, sf_dir).views, attribute).selectExpr(*[c.strip() for c in columns.split(",")])


view("effective_properties", "effective_properties", COPIED, "effective")
view("classification_chain", "classification_chain", "ref_id, node_id", "chain")
view("classification_codes", "classification_codes", "ref_id, system, code", "codes")
view("classifications", "classifications", "entity_id, system, code", "classes")
view("materials", "materials", "entity_id, material_entity_id, name, category", "stuff")
view(
    "material_classifications", "material_classifications", "material_entity_id, system, code",
    """(SELECT m.entity_id AS material_entity_id, coalesce(r.name, '') AS system, coalesce(r.identification, '') AS code
       FROM triples a JOIN entities r ON r.entity_id = a.object JOIN triples b ON b.subject = a.subject JOIN entities m ON m.entity_id = b.object
       WHERE a.predicate = 'hasMaterialClassification' AND r.ifc_type LIKE '%CLASSIFICATION%' AND m.ifc_type LIKE '%MATERIAL%')""",
)
view("documents", "documents", "entity_id, title, location", "(SELECT t.subject AS entity_id, e.name AS title, e.identification AS location FROM triples t JOIN entities e ON e.entity_id = t.object WHERE t.predicate = 'IfcRelAssociatesDocument' AND e.ifc_type LIKE '%DOCUMENT%')")


# Facets on doors


def facet(name: str, wanted: Facet, oracle: str, scope: str = "IFCDOOR", what: str = "test") -> None:
    @register(name, f"SELECT d.entity_id, coalesce({oracle}, false) AS ok FROM entities d WHERE d.ifc_type = '{scope}'", model=True)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star_model(spark, sf_dir)
        entities = tables.entities.where(F.col("ifc_type") == scope)
        return FacetPlanner(tables).attach(entities, [Ask("ok", wanted, what)]).select("entity_id", "ok")


_PT = "d.entity_id IN (SELECT o.entity_id FROM entities o LEFT JOIN types t ON t.entity_id = o.entity_id LEFT JOIN entities y ON y.entity_id = t.type_id AND y.predefined_type IS NOT NULL AND y.predefined_type <> 'NOTDEFINED' LEFT JOIN entity_attributes a ON a.entity_id = coalesce(y.entity_id, o.entity_id) AND a.attr_name IN ('ElementType', 'ObjectType') WHERE coalesce(y.predefined_type, o.predefined_type) IN ({0}) OR (coalesce(y.predefined_type, o.predefined_type) = 'USERDEFINED' AND a.value IN ({0})))"
facet("facet_entity", Entity(OneOf(("IFCDOOR", "IFCDOORTYPE"))), "d.ifc_type IN ('IFCDOOR', 'IFCDOORTYPE')", "IFCDOORTYPE")
facet("facet_entity_predefined", Entity(Simple("IFCDOOR"), OneOf(("DOOR", "FURNITURE"))), _PT.format("'DOOR', 'FURNITURE'"))
facet("facet_attribute_tier1", Attribute(Simple("DESCRIPTION"), OneOf(("1-URGENT", "2-HIGH"))), "d.description IN ('1-URGENT', '2-HIGH')")
facet("facet_attribute_other", Attribute(Simple("overallheight"), Bounds(low=50, low_included=True)), "d.entity_id IN (SELECT entity_id FROM entity_attributes WHERE attr_name = 'OverallHeight' AND TRY_CAST(value AS DOUBLE) >= 50)")
facet("facet_attribute_name_pattern", Attribute(Pattern("Object.*|Overall.*"), Simple("5-LOW")), "d.entity_id IN (SELECT entity_id FROM entity_attributes WHERE regexp_full_match(attr_name, 'Object.*|Overall.*') AND value = '5-LOW')")
facet("facet_attribute_empty_name", Attribute(Simple("")), "false")
_PROPERTY = """d.entity_id IN (SELECT entity_id FROM (SELECT entity_id, pset_name, bool_or(named) AS has_name, bool_and(NOT named OR ok) AS fine FROM (
  SELECT entity_id, pset_name, property_name, property_name = '{name}' AS named, bool_or(coalesce({ok}, false)) AS ok FROM effective WHERE {sets} GROUP BY entity_id, pset_name, property_name)
  GROUP BY entity_id, pset_name) GROUP BY entity_id HAVING bool_and(has_name AND fine))"""
facet("facet_property", Property(Simple("Pset_Common"), Simple("Segment"), OneOf(("OVERRIDE", "BUILDING"))), _PROPERTY.format(name="Segment", ok="value IN ('OVERRIDE', 'BUILDING')", sets="pset_name = 'Pset_Common'"))
facet("facet_property_datatype", Property(Simple("Pset_Common"), Simple("Approved"), Simple("true"), "IfcBoolean"), _PROPERTY.format(name="Approved", ok="data_type = 'IFCBOOLEAN' AND lower(value) = 'true'", sets="pset_name = 'Pset_Common'"))
facet("facet_property_measure", QUANTITY, _PROPERTY.format(name="Quantity", ok="value_si >= 0.01", sets="pset_name LIKE 'Pset_Line%'"))
facet("facet_property_any_value", Property(Pattern("Pset_Line[12]"), Simple("ReturnFlag")), _PROPERTY.format(name="ReturnFlag", ok="value <> ''", sets="pset_name IN ('Pset_Line1', 'Pset_Line2')"))
facet("facet_classification", Classification(Simple("ASIA"), Pattern("N-1.*")), "d.entity_id IN (SELECT entity_id FROM classes WHERE system = 'ASIA' AND code LIKE 'N-1%')")
facet("facet_material", Material(Simple("PROMO")), "d.entity_id IN (SELECT entity_id FROM stuff WHERE name = 'PROMO' OR category = 'PROMO')")
_NESTS = "triples n JOIN triples a ON a.object = n.subject AND a.predicate = 'IfcRelAggregates'"
facet("facet_partof_direct", PartOf("IFCRELNESTS", Entity(Simple("IFCDOORTYPE"))), "d.entity_id IN (SELECT object FROM triples WHERE predicate = 'IfcRelNests')")
facet("facet_partof_transitive", PartOf("", Entity(Simple("IFCSITE"))), f"d.entity_id IN (SELECT n.object FROM {_NESTS} JOIN triples b ON b.object = a.subject AND b.predicate = 'IfcRelAggregates' WHERE n.predicate = 'IfcRelNests')")
facet("facet_partof_any", PartOf("IFCRELAGGREGATES"), "d.entity_id IN (SELECT object FROM triples WHERE predicate = 'IfcRelAggregates')", "IFCDOORTYPE")
facet("facet_partof_whole_predefined", PartOf("", Entity(Simple("IFCDOORTYPE"), Simple("GATE"))), "d.entity_id IN (SELECT t.object FROM triples t JOIN entities w ON w.entity_id = t.subject WHERE t.predicate = 'IfcRelNests' AND w.predefined_type = 'GATE')")
facet("anchor_attribute", Attribute(Simple("Description"), Simple("x")), "d.description IS NOT NULL OR coalesce(d.empty_attrs, '') LIKE '%,description,%'", what="anchor")
facet("anchor_attribute_other", Attribute(Simple("OverallHeight"), Simple("x")), "true", what="anchor")
facet("anchor_property", Property(Simple("Pset_Common"), Simple("Approved"), Simple("x"), "IFCLABEL"), _PROPERTY.format(name="Approved", ok="value <> ''", sets="pset_name = 'Pset_Common'"), what="anchor")
facet("anchor_classification", Classification(Simple("x")), "d.entity_id IN (SELECT entity_id FROM classes)", what="anchor")
facet("anchor_material", Material(Simple("x")), "d.entity_id IN (SELECT entity_id FROM stuff)", what="anchor")


# Cardinalities and found values

COMMON = Property(Simple("Pset_Common"), Simple("Approved"), Simple("true"))
_COMMON_OK = _PROPERTY.format(name="Approved", ok="lower(value) = 'true'", sets="pset_name = 'Pset_Common'")
_COMMON_THERE = _PROPERTY.format(name="Approved", ok="value <> ''", sets="pset_name = 'Pset_Common'")
for kind, sql in (("required", _COMMON_OK), ("prohibited", f"NOT ({_COMMON_OK})"), ("optional", f"({_COMMON_OK}) OR NOT ({_COMMON_THERE})")):

    @register(f"cardinality_{kind}", f"SELECT d.entity_id, {sql} AS met FROM doors d", model=True)
    def cardinality_query(spark: SparkSession, sf_dir: str, kind=kind) -> DataFrame:
        requirement = Requirement(COMMON, kind)
        return spec_frame(star_model(spark, sf_dir), door_spec(requirement)).select("entity_id", verdict(requirement, 0).alias("met"))


def value(name: str, wanted: Facet, oracle: str) -> None:
    @register(name, f"SELECT d.entity_id, {oracle} AS found FROM doors d", model=True)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spec_frame(star_model(spark, sf_dir), door_spec(wanted)).select("entity_id", F.col("val0").alias("found"))


value("value_attribute", Attribute(Simple("name")), "d.name")
value("value_attribute_list", Attribute(Simple("ObjectType")), "d.object_type")
value("value_attribute_other", Attribute(Simple("OverallHeight")), "nullif((SELECT string_agg(value, ', ' ORDER BY value) FROM entity_attributes a WHERE a.entity_id = d.entity_id AND a.attr_name = 'OverallHeight'), '')")
value("value_property", Property(Simple("Pset_Common"), Simple("Segment")), "(SELECT min(value) FROM effective p WHERE p.entity_id = d.entity_id AND p.pset_name = 'Pset_Common' AND p.property_name = 'Segment')")


# Specifications, progress and reports

MIXED = door_spec(Requirement(Attribute(Simple("Description"))), Requirement(COMMON, "optional"), Requirement(Attribute(Simple("Description"), Simple("5-LOW")), "prohibited"))
_MIXED_CHECKS = f"SELECT d.entity_id, d.name, d.description, coalesce(d.description <> '', false) AS c0, ({_COMMON_OK}) OR NOT ({_COMMON_THERE}) AS c1, NOT coalesce(d.description = '5-LOW', false) AS c2 FROM doors d"


@register("spec_applicable", "SELECT d.entity_id, d.ifc_type, d.name FROM doors d WHERE d.description = '1-URGENT' AND d.entity_id IN (SELECT entity_id FROM classes WHERE system = 'ASIA')", model=True)
def spec_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = door_spec(applicability=(DOOR, Attribute(Simple("Description"), Simple("1-URGENT")), Classification(Simple("ASIA"))))
    return spec_frame(star_model(spark, sf_dir), spec).select("entity_id", "ifc_type", "name")


@register("spec_verdict", f"SELECT entity_id, c0 AND c1 AND c2 AS passed, CASE WHEN c0 AND c1 AND c2 THEN 'pass' WHEN NOT (c0 OR c1 OR c2) THEN 'fail' ELSE 'partial' END AS status FROM ({_MIXED_CHECKS})", model=True)
def spec_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = evaluate_spec(star_model(spark, sf_dir), MIXED)
    return outcome.select("entity_id", (report.n_passed() == F.size("checks")).alias("passed"), report.element_status().alias("status"))


@register(
    "spec_cardinality",
    """SELECT * FROM (VALUES ('optional', 0::BIGINT, true, NULL), ('prohibited', 0, true, NULL), ('required', 0, false, 'Required, but no applicable entity found in the model.')) t(kind, n_applicable, satisfied, reason)
       UNION ALL SELECT 'prohibited doors', count(*), count(*) = 0, concat('Prohibited, but ', count(*)::VARCHAR, ' applicable entities found.') FROM doors""",
    model=True,
)
def spec_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star_model(spark, sf_dir)
    out = None
    for kind, how, scope in (("optional", "optional", "IFCWALL"), ("prohibited", "prohibited", "IFCWALL"), ("required", "required", "IFCWALL"), ("prohibited doors", "prohibited", "IFCDOOR")):
        spec = door_spec(cardinality=how, applicability=(Entity(Simple(scope)),))
        made = cardinality(evaluate_spec(tables, spec), spec).select(F.lit(kind).alias("kind"), "n_applicable", "satisfied", "reason")
        out = made if out is None else out.unionByName(made)
    return out


@register(
    "report_progress",
    f"""SELECT count_if(n = 3)::BIGINT AS n_pass, count_if(n IN (1, 2))::BIGINT AS n_partial, count_if(n = 0)::BIGINT AS n_fail, sum(n)::BIGINT AS checks_passed, 3 * count(*) AS checks_total, floor(100.0 * sum(n) / (3 * count(*)) + 0.5)::INT AS percent
        FROM (SELECT c0::INT + c1::INT + c2::INT AS n FROM ({_MIXED_CHECKS}))""",
    model=True,
)
def report_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.spec_progress(evaluate_spec(star_model(spark, sf_dir), MIXED)).drop("spec_id")


_ROWS = f"""SELECT 'Doors' AS spec_name, 'Model M' AS model, entity_id::VARCHAR AS entity_id, 'IFCDOOR' AS ifc_type, name AS entity_name, requirement, expected, found FROM (
  SELECT entity_id, name, 'Attribute Description' AS requirement, 'required' AS expected, coalesce(nullif(description, ''), '(missing)') AS found FROM ({_MIXED_CHECKS}) WHERE NOT c0
  UNION ALL SELECT c.entity_id, c.name, 'Property Pset_Common.Approved', 'optional', coalesce((SELECT min(value) FROM effective p WHERE p.entity_id = c.entity_id AND p.pset_name = 'Pset_Common' AND p.property_name = 'Approved'), '(missing)') FROM ({_MIXED_CHECKS}) c WHERE NOT c1
  UNION ALL SELECT entity_id, name, 'No Attribute Description', 'must NOT be present', description FROM ({_MIXED_CHECKS}) WHERE NOT c2)"""


@register("report_rows", _ROWS, model=True)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_rows(evaluate_spec(star_model(spark, sf_dir), MIXED), MIXED, {"m": "Model M"}).select(*report.REPORT_COLUMNS)


@register("report_csv_line", f"SELECT concat_ws(',', spec_name, model, entity_id, ifc_type, entity_name, requirement, expected, found) AS line FROM ({_ROWS})", model=True)
def report_csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(spark, sf_dir).select(report.csv_line().alias("line"))


@register("report_csv_quoting", """SELECT page_id, CASE WHEN regexp_matches(html, '[",\\r\\n]') THEN '"' || replace(html, '"', '""') || '"' ELSE html END AS cell FROM pages""")
def report_csv_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", report.csv_cell(F.col("html")).alias("cell"))


@register("report_verdict", "SELECT * FROM (VALUES ('doors', 'Fail'), ('none', 'N/A'), ('named', 'Pass')) t(kind, verdict)")
def report_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star_model(spark, sf_dir)
    specs = {"doors": MIXED, "none": door_spec(cardinality="optional", applicability=(Entity(Simple("IFCWALL")),)), "named": door_spec(Attribute(Simple("Name")))}
    out = None
    for kind, spec in specs.items():
        made = report.spec_verdict(evaluate_spec(tables, spec), spec).select(F.lit(kind).alias("kind"), "verdict")
        out = made if out is None else out.unionByName(made)
    return out


@register("report_split_uid", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'm' ELSE 'a:b' END AS model, CAST(o_orderkey AS VARCHAR) AS entity FROM orders")
def report_split_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.expr("concat(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'm:' ELSE 'a:b:' END, o_orderkey)")
    model, entity = report.split_uid(uid)
    return table(spark, sf_dir, "orders").select("o_orderkey", model.alias("model"), entity.alias("entity"))


# Lookups


@register(
    "lookup_elements",
    "SELECT concat('m:', CAST(10000000 + o_orderkey AS VARCHAR)) AS uid, concat('Order#', CAST(o_orderkey AS VARCHAR)) AS name FROM orders WHERE o_orderkey % 10 <> 3",
)
def lookup_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uids with a wrong form are ignored, repeated ones count once."""
    made = F.expr("CASE o_orderkey % 10 WHEN 3 THEN concat('m:x', o_orderkey) ELSE concat('m:', 10000000 + o_orderkey) END")
    orders = table(spark, sf_dir, "orders")
    uids = orders.select(made.alias("uid"))
    return lookup.element_info(star_model(spark, sf_dir), uids.unionByName(uids)).select("uid", "name")


@register("lookup_model_info", "SELECT 'm' AS model_id, CAST(10 + r_regionkey AS INT) AS project_id, concat('Project ', r_name) AS name, r_name AS long_name FROM region WHERE r_regionkey = 0")
def lookup_model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.model_info(star_model(spark, sf_dir)).select("model_id", "project_id", "name", "long_name")


@register(
    "lookup_bbox_axes",
    "SELECT CAST(2000000 + c_custkey AS INT) AS entity_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey::DOUBLE END AS x0, CASE WHEN c_custkey % 5 <> 0 THEN -(c_custkey * 3 + 1)::DOUBLE END AS y0, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 2 + 1)::DOUBLE END AS z1 FROM customer",
)
def lookup_bbox_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_model(spark, sf_dir).entities.where("ifc_type = 'IFCDOORTYPE'").select("entity_id", lookup.ifc_box().alias("b"))
    return rows.select("entity_id", *[F.get("b", F.lit(k)).alias(n) for k, n in ((0, "x0"), (1, "y0"), (5, "z1"))])


# STEP text


def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as STEP text, 64 models; names hold quotes, commas, semicolons and brackets."""
    name = step.encode_text(F.expr("concat('Order, ''', o_orderkey, '''; (#', o_orderkey % 7, ')')"))
    line = F.concat(F.lit("#"), F.col("o_orderkey") + 1, F.lit("= IFCDOOR('"), F.lpad(F.col("o_orderkey").cast("string"), 22, "0"), F.lit("',$,"), name, F.lit(",\n   '"), F.col("o_orderpriority"), F.lit("',$,#"), F.col("o_custkey") + 1, F.lit(",(#5,#6),IFCLABEL('t'),$,$,.STATUS_"), F.col("o_orderstatus"), F.lit(".,*,$);"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey") % 64).alias("model_id"), "o_orderkey", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("model_id").agg(F.concat(F.lit("ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('ifc4'));\nENDSEC;\nDATA;\n"), body, F.lit("\nENDSEC;\n")).alias("text"))


_ORDER_NAME = "concat('Order, ''', CAST(o_orderkey AS VARCHAR), '''; (#', CAST(o_orderkey % 7 AS VARCHAR), ')')"


@register("step_records_roundtrip", f"SELECT concat('m', CAST(o_orderkey % 64 AS VARCHAR)) AS model_id, CAST(o_orderkey + 1 AS INT) AS entity_id, 'IFCDOOR' AS ifc_type, {_ORDER_NAME} AS name, o_orderpriority AS description, concat('STATUS_', o_orderstatus) AS status FROM orders")
def step_records_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    arg = lambda k: step.decode_arg(F.get("arg_list", F.lit(k)))
    return step.records(step_texts(spark, sf_dir)).select("model_id", "entity_id", "ifc_type", arg(2).alias("name"), arg(3).alias("description"), arg(10).alias("status"))


@register("step_split_args", "SELECT CAST(o_orderkey + 1 AS INT) AS entity_id, 13 AS n_args, CAST(o_custkey + 1 AS INT) AS ref, 't' AS tag, 'IFCLABEL' AS tag_type, 0 AS depth FROM orders")
def step_split_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = step.records(step_texts(spark, sf_dir)).select("entity_id", "args", step.split_args("args").alias("a"))
    return rows.select("entity_id", F.size("a").alias("n_args"), step.ref_id(F.get("a", F.lit(5))).alias("ref"), step.decode_arg(F.get("a", F.lit(7))).alias("tag"), step.cast_name(F.get("a", F.lit(7))).alias("tag_type"), step.open_depth(F.col("args")).alias("depth"))


@register("step_decode", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN 'TRUE' WHEN 2 THEN 'NOTDEFINED' WHEN 3 THEN NULL WHEN 4 THEN CAST(c_custkey AS VARCHAR) || '.5' ELSE 'it''s ' || c_mktsegment END AS v FROM customer")
def step_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE c_custkey % 6 WHEN 0 THEN concat('IFCLABEL(''', c_name, ''')') WHEN 1 THEN '.T.' WHEN 2 THEN '.NOTDEFINED.' WHEN 3 THEN CASE WHEN c_custkey % 2 = 1 THEN '$' ELSE '''''' END WHEN 4 THEN concat('IFCREAL(', c_custkey, '.5)') ELSE concat('''it''''s ', c_mktsegment, '''') END")
    return table(spark, sf_dir, "customer").select("c_custkey", step.decode_arg(raw).alias("v"))


@register("step_list_refs", "SELECT CAST(o_orderkey + 1 AS INT) AS entity_id, [CAST(o_custkey + 1 AS INT), 5, 6]::VARCHAR AS refs FROM orders")
def step_list_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = step.list_refs(F.col("args"))
    return step.records(step_texts(spark, sf_dir)).select("entity_id", F.concat(F.lit("["), F.array_join(refs.cast("array<string>"), ", "), F.lit("]")).alias("refs"))


@register("step_encode_args", "SELECT o_orderkey, '#' || (o_custkey + 1) || ',''it''''s, ' || o_orderpriority || ''',.' || o_orderstatus || '.,(#1,$,#' || o_orderkey || '),' || o_orderkey || ',$' AS args, 6 AS n FROM orders")
def step_encode_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values become the text of a record's arguments, which splits into as many again."""
    key = F.col("o_orderkey")
    listed = step.encode_list(F.array(step.encode_ref(F.lit(1)), F.lit(None).cast("string"), step.encode_ref(key)))
    args = step.encode_args(step.encode_ref(F.col("o_custkey") + 1), step.encode_text(F.concat(F.lit("it's, "), F.col("o_orderpriority"))), step.encode_enum(F.col("o_orderstatus")), listed, step.encode_number(key), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", args.alias("args")).withColumn("n", F.size(step.split_args("args")))


@register("step_schema", "SELECT DISTINCT concat('m', CAST(o_orderkey % 64 AS VARCHAR)) AS model_id, 'IFC4' AS schema FROM orders")
def step_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_texts(spark, sf_dir).select("model_id", step.schema_name(F.col("text")).alias("schema"))


@register("step_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN l_quantity WHEN 1 THEN (l_orderkey % 4096)::DOUBLE WHEN 2 THEN l_quantity * 1000 END AS v FROM lineitem")
def step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE l_partkey % 4 WHEN 0 THEN concat(' ', cast(l_quantity as int), '. ') WHEN 1 THEN concat('0x', hex(l_orderkey % 4096)) WHEN 2 THEN concat(cast(l_quantity as int), 'e3') ELSE concat(cast(l_quantity as int), 'd') END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", script_number(text).alias("v"))


# Global ids


def _hex_id(key: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.expr(f"({key} * 2654435761) % 1099511627776")), 16, "0"), F.lpad(F.hex(F.expr(f"({key} * 40503 + 7) % 1099511627776")), 16, "a")))


_SQL_ID = "lower(concat(lpad(printf('%X', (o_orderkey * 2654435761) % 1099511627776), 16, '0'), lpad(printf('%X', (o_orderkey * 40503 + 7) % 1099511627776), 16, 'a')))"
_SQL_GUID = f"regexp_replace({_SQL_ID}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@register("guid_roundtrip", f"SELECT o_orderkey, {_SQL_GUID} AS guid, 22 AS n FROM orders")
def guid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = guid.encode(_hex_id("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", short.alias("s")).select("o_orderkey", guid.decode(F.col("s")).alias("guid"), F.length("s").alias("n"))


@register("guid_canonical", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN {_SQL_GUID} END AS guid FROM orders")
def guid_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braced capitals, plain digits and the compressed form give the same id; other text gives none."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" {"), F.upper(_hex_id("o_orderkey")), F.lit("}"))).when(F.col("o_orderkey") % 4 == 1, _hex_id("o_orderkey")).when(F.col("o_orderkey") % 4 == 2, guid.encode(_hex_id("o_orderkey"))).otherwise("no id")
    return table(spark, sf_dir, "orders").select("o_orderkey", guid.canonical(raw).alias("guid"))


# Units, edges and ingest over rendered records


@register(
    "unit_si_factor",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN pow(0.001, 2) ELSE 1.0 END::DOUBLE AS factor,
       CASE c_custkey % 3 WHEN 0 THEN 'MILLIMETRE' WHEN 1 THEN 'SQUARE MILLIMETRE' ELSE 'CANDELA' END AS label FROM customer""",
)
def unit_si_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("c_custkey") % 3 < 2, "MILLI")
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'METRE' WHEN 1 THEN 'SQUARE_METRE' ELSE 'LUMINOUS_INTENSITY' END")
    return table(spark, sf_dir, "customer").select("c_custkey", units.si_factor(prefix, name).alias("factor"), units.unit_label(prefix, name).alias("label"))


def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one small model each: a door with a type, a property set, units and a placement."""
    key = F.col("c_custkey").cast("string")
    lines = [
        F.lit("#1=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);"),
        F.lit("#2=IFCMEASUREWITHUNIT(IFCLENGTHMEASURE(25.4),#1);"),
        F.lit("#3=IFCCONVERSIONBASEDUNIT(#99,.LENGTHUNIT.,'INCH',#2);"),
        F.lit("#4=IFCUNITASSIGNMENT((#1));"),
        F.lit("#5=IFCLOCALPLACEMENT($,#6);"),
        F.concat(F.lit("#10=IFCDOOR('0000000000000000000000',$,'Door "), key, F.lit("','',$,#5,$,'T"), key, F.lit("',2.1,0.9,.DOOR.,$,$);")),
        F.lit("#11=IFCDOORTYPE('0000000000000000000001',$,'Type',$,$,(#20),$,$,$,.DOOR.,$);"),
        F.lit("#12=IFCRELDEFINESBYTYPE('0000000000000000000002',$,$,$,(#10),#11);"),
        F.lit("#20=IFCPROPERTYSET('0000000000000000000003',$,'Pset_Door',$,(#21,#22,#23));"),
        F.concat(F.lit("#21=IFCPROPERTYSINGLEVALUE('Width',$,IFCLENGTHMEASURE("), key, F.lit(".),$);")),
        F.concat(F.lit("#22=IFCPROPERTYSINGLEVALUE('Depth',$,IFCLENGTHMEASURE("), key, F.lit(".),#3);")),
        F.concat(F.lit("#23=IFCPROPERTYLISTVALUE('Names',$,(IFCLABEL('"), F.col("c_mktsegment"), F.lit("'),IFCLABEL('b')),$);")),
        F.lit("#24=IFCRELDEFINESBYPROPERTIES('0000000000000000000004',$,$,$,(#10),#25);"),
        F.lit("#25=IFCDOORLININGPROPERTIES('0000000000000000000005',$,'Lining',$,50.,$);"),
        F.lit("#30=IFCPERSON('P',$,('x','y'),$,$,$,$,$);"),
        F.lit("#31=IFCAPPLICATION(#30,'1','App','App');"),
    ]
    texts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("model_id"), F.concat_ws("\n", *lines).alias("text"))
    return step.records(texts)


def _per_customer(values: str, columns: str) -> str:
    return f"SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS model_id, {columns} FROM customer, (VALUES {values}) t"


@register("unit_conversion", _per_customer("(1, 'LENGTHUNIT', 'MILLIMETRE', 0.001::DOUBLE), (3, 'LENGTHUNIT', 'INCH', (25.4::DOUBLE * 0.001))", "t.col0 AS unit_id, t.col1 AS unit_type, t.col2 AS label, t.col3 AS factor"))
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unit_table(model_records(spark, sf_dir)).select("model_id", "unit_id", "unit_type", "label", "factor")


@register(
    "unit_value_si",
    """SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS model_id, t.col0 AS property_name, c_custkey::DOUBLE AS value_num, c_custkey::DOUBLE * t.col2 AS value_si, t.col1 AS unit
       FROM customer, (VALUES ('Width', 'MILLIMETRE', 0.001::DOUBLE), ('Depth', 'INCH', 25.4::DOUBLE * 0.001::DOUBLE)) t""",
)
def unit_value_si(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = model_records(spark, sf_dir)
    rows = ingest.with_units(ingest.authored_values(records), records).where("measure = 'IFCLENGTHMEASURE'")
    return rows.select("model_id", "property_name", "value_num", "value_si", "unit")


_EDGE = "t.col0 AS subject, t.col1 AS predicate, t.col2 AS object"
_REL = "(11, 'IfcRelDefinesByType', 10), (10, 'IfcRelDefinesByProperties', 25)"
_SYN = "(20, 'hasProperty', 21), (20, 'hasProperty', 22), (20, 'hasProperty', 23)"
_TYP = "(11, 'hasPropertySet', 20)"
_GEN = "(2, 'references', 1), (3, 'references', 2), (4, 'references', 1), (22, 'references', 3), (31, 'references', 30)"
for name, values, maker in (
    ("edges_rel", _REL, edges.relationship_edges),
    ("edges_synthetic", _SYN, edges.synthetic_edges),
    ("edges_type_pset", _TYP, edges.type_property_edges),
    ("edges_generic", _GEN, lambda r: edges.edges_of(edges.extract_edges(r), "references")),
    ("edges_profile", f"{_REL}", lambda r: edges.extract_edges(r, "qto")),
    ("edges_all", f"{_REL}, {_SYN}, {_TYP}, {_GEN}", edges.extract_edges),
):

    @register(name, _per_customer(values, _EDGE))
    def edge_query(spark: SparkSession, sf_dir: str, maker=maker) -> DataFrame:
        return maker(model_records(spark, sf_dir)).select("model_id", "subject", "predicate", "object")


@register(
    "ingest_entities",
    """SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS model_id, 10 AS entity_id, 'IFCDOOR' AS ifc_type, concat('Door ', CAST(c_custkey AS VARCHAR)) AS name, concat('T', CAST(c_custkey AS VARCHAR)) AS tag, 'DOOR' AS predefined_type,
       NULL::VARCHAR AS description, ',description,' AS empty_attrs, '00000000-0000-0000-0000-000000000000' AS global_id_canonical FROM customer""",
)
def ingest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.ingest(model_records(spark, sf_dir)).entities.where("ifc_type = 'IFCDOOR'")
    return rows.select("model_id", "entity_id", "ifc_type", "name", "tag", "predefined_type", "description", "empty_attrs", "global_id_canonical")


@register(
    "ingest_psets",
    """SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS model_id, 11 AS entity_id, 'Pset_Door' AS pset_name, t.col0 AS property_name,
         CASE t.col1 WHEN 'num' THEN CAST(c_custkey AS VARCHAR) || '.' WHEN 'seg' THEN c_mktsegment ELSE 'b' END AS value, CASE WHEN t.col1 = 'num' THEN 'IFCLENGTHMEASURE' ELSE 'IFCLABEL' END AS data_type
       FROM customer, (VALUES ('Width', 'num'), ('Depth', 'num'), ('Names', 'seg'), ('Names', 'b')) t
       UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), 10, 'Lining', 'LiningDepth', '50.', NULL FROM customer""",
)
def ingest_psets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(model_records(spark, sf_dir)).properties.select("model_id", "entity_id", "pset_name", "property_name", "value", "data_type")


def suppliers_as_models(spark: SparkSession, sf_dir: str, lines: list[str], schema: str = "IFC4") -> DataFrame:
    """The records of these lines, once for each supplier, as a model of its own; ``{key}`` stands for the supplier's key."""
    text = F.lit(f"FILE_SCHEMA(('{schema}'));\nDATA;\n" + "\n".join(lines))
    key = F.col("s_suppkey").cast("string")
    return step.records(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key).alias("model_id"), F.replace(text, F.lit("{key}"), key).alias("text")))


def _per_supplier(rows: list[tuple], columns: str) -> str:
    literal = lambda v: "NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS model_id, {columns} FROM supplier, (VALUES {values}) t"


#: One record for each edge rule, number 9 beside the walls 1 to 3, and the edges that it makes.
EDGE_CASES = """
IFCRELAGGREGATES('g',$,$,$,#1,(#2,#3)) IfcRelAggregates 1>2 1>3
IFCRELCONTAINEDINSPATIALSTRUCTURE('g',$,$,$,(#2,#3),#1) IfcRelContainedInSpatialStructure 1>2 1>3
IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#1,#2),#3) IfcRelDefinesByProperties 1>3 2>3
IFCRELDEFINESBYTYPE('g',$,$,$,(#1,#2),#3) IfcRelDefinesByType 3>1 3>2
IFCRELVOIDSELEMENT('g',$,$,$,#1,#2) IfcRelVoidsElement 1>2
IFCRELFILLSELEMENT('g',$,$,$,#1,#2) IfcRelFillsElement 1>2
IFCRELCONNECTSELEMENTS('g',$,$,$,$,#1,#2) IfcRelConnectsElements 1>2
IFCRELCONNECTSPATHELEMENTS('g',$,$,$,$,#1,#2,(),(),.ATEND.,.ATSTART.) IfcRelConnectsPathElements 1>2
IFCRELASSOCIATESCLASSIFICATION('g',$,$,$,(#1,#2),#3) IfcRelAssociatesClassification 1>3 2>3
IFCRELASSOCIATESDOCUMENT('g',$,$,$,(#1,#2),#3) IfcRelAssociatesDocument 1>3 2>3
IFCRELASSOCIATESMATERIAL('g',$,$,$,(#1,#2),#3) IfcRelAssociatesMaterial 1>3 2>3
IFCRELASSIGNSTOGROUP('g',$,$,$,(#1,#2),$,#3) IfcRelAssignsToGroup 3>1 3>2
IFCRELSPACEBOUNDARY('g',$,$,$,#1,#2,$,.PHYSICAL.,.EXTERNAL.) IfcRelSpaceBoundary 1>2
IFCRELSPACEBOUNDARY1STLEVEL('g',$,$,$,#1,#2,$,.PHYSICAL.,.EXTERNAL.,$) IfcRelSpaceBoundary 1>2
IFCRELSPACEBOUNDARY2NDLEVEL('g',$,$,$,#1,#2,$,.PHYSICAL.,.EXTERNAL.,$,$) IfcRelSpaceBoundary 1>2
IFCRELNESTS('g',$,$,$,#1,(#2,#3)) IfcRelNests 1>2 1>3
IFCRELDECLARES('g',$,$,$,#1,(#2,#3)) IfcRelDeclares 1>2 1>3
IFCRELDEFINESBYOBJECT('g',$,$,$,(#1,#2),#3) IfcRelDefinesByObject 3>1 3>2
IFCRELDEFINESBYTEMPLATE('g',$,$,$,(#1,#2),#3) IfcRelDefinesByTemplate 3>1 3>2
IFCRELASSIGNSTOACTOR('g',$,$,$,(#1,#2),$,#3,$) IfcRelAssignsToActor 3>1 3>2
IFCRELASSIGNSTOCONTROL('g',$,$,$,(#1,#2),$,#3) IfcRelAssignsToControl 3>1 3>2
IFCRELASSIGNSTOGROUPBYFACTOR('g',$,$,$,(#1,#2),$,#3,0.5) IfcRelAssignsToGroup 3>1 3>2
IFCRELASSIGNSTOPROCESS('g',$,$,$,(#1,#2),$,#3,$) IfcRelAssignsToProcess 3>1 3>2
IFCRELASSIGNSTOPRODUCT('g',$,$,$,(#1,#2),$,#3) IfcRelAssignsToProduct 3>1 3>2
IFCRELASSIGNSTORESOURCE('g',$,$,$,(#1,#2),$,#3) IfcRelAssignsToResource 3>1 3>2
IFCRELASSOCIATESAPPROVAL('g',$,$,$,(#1,#2),#3) IfcRelAssociatesApproval 1>3 2>3
IFCRELASSOCIATESCONSTRAINT('g',$,$,$,(#1,#2),'intent',#3) IfcRelAssociatesConstraint 1>3 2>3
IFCRELASSOCIATESLIBRARY('g',$,$,$,(#1,#2),#3) IfcRelAssociatesLibrary 1>3 2>3
IFCRELASSOCIATESPROFILEDEF('g',$,$,$,(#1,#2),#3) IfcRelAssociatesProfileDef 1>3 2>3
IFCRELADHERESTOELEMENT('g',$,$,$,#1,(#2,#3)) IfcRelAdheresToElement 1>2 1>3
IFCRELCOVERSBLDGELEMENTS('g',$,$,$,#1,(#2,#3)) IfcRelCoversBldgElements 1>2 1>3
IFCRELCOVERSSPACES('g',$,$,$,#1,(#2,#3)) IfcRelCoversSpaces 1>2 1>3
IFCRELPROJECTSELEMENT('g',$,$,$,#1,#2) IfcRelProjectsElement 1>2
IFCRELCONNECTSPORTTOELEMENT('g',$,$,$,#1,#2) IfcRelConnectsPortToElement 1>2
IFCRELCONNECTSPORTS('g',$,$,$,#1,#2,$) IfcRelConnectsPorts 1>2
IFCRELCONNECTSSTRUCTURALACTIVITY('g',$,$,$,#1,#2) IfcRelConnectsStructuralActivity 1>2
IFCRELCONNECTSSTRUCTURALMEMBER('g',$,$,$,#1,#2,$,$,$,$) IfcRelConnectsStructuralMember 1>2
IFCRELCONNECTSWITHECCENTRICITY('g',$,$,$,#1,#2,$,$,$,$,$) IfcRelConnectsStructuralMember 1>2
IFCRELCONNECTSWITHREALIZINGELEMENTS('g',$,$,$,$,#1,#2,(#3),$) IfcRelConnectsElements 1>2
IFCRELINTERFERESELEMENTS('g',$,$,$,#1,#2,$,$,.F.) IfcRelInterferesElements 1>2
IFCRELFLOWCONTROLELEMENTS('g',$,$,$,(#1,#2),#3) IfcRelFlowControlElements 3>1 3>2
IFCRELSEQUENCE('g',$,$,$,#1,#2,$,.FINISH_START.,$) IfcRelSequence 1>2
IFCRELSERVICESBUILDINGS('g',$,$,$,#1,(#2,#3)) IfcRelServicesBuildings 1>2 1>3
IFCRELREFERENCEDINSPATIALSTRUCTURE('g',$,$,$,(#2,#3),#1) IfcRelReferencedInSpatialStructure 1>2 1>3
IFCRELPOSITIONS('g',$,$,$,#1,(#2,#3)) IfcRelPositions 1>2 1>3
IFCEXTERNALREFERENCERELATIONSHIP('n',$,#3,(#1,#2)) IfcRelAssociatesClassification 1>3 2>3 hasMaterialClassification 9>3
IFCMATERIALCONSTITUENTSET('n',$,(#1,#2)) hasMaterialConstituent 9>1 9>2
IFCMATERIALLAYERSET((#1,#2),'n',$) hasMaterialLayer 9>1 9>2
IFCMATERIALPROFILESET('n',$,(#1,#2),$) hasMaterialProfile 9>1 9>2
IFCMATERIALLIST((#1,#2)) hasMaterial 9>1 9>2
IFCMATERIALCONSTITUENT('n',$,#1,$,$) hasMaterial 9>1
IFCMATERIALLAYER(#1,0.2,$,'n',$,$,$) hasMaterial 9>1
IFCMATERIALPROFILE('n',$,#1,$,$,$) hasMaterial 9>1
IFCMATERIALLAYERWITHOFFSETS(#1,0.2,$,'n',$,$,$,.AXIS1.,(0.)) hasMaterial 9>1
IFCMATERIALPROFILEWITHOFFSETS('n',$,#1,$,$,$,(0.)) hasMaterial 9>1
IFCMATERIALLAYERSETUSAGE(#1,.AXIS2.,.POSITIVE.,0.,$) hasMaterialLayerSet 9>1
IFCMATERIALPROFILESETUSAGE(#1,5,$) hasMaterialProfileSet 9>1
IFCMATERIALCLASSIFICATIONRELATIONSHIP((#1,#2),$) hasMaterialClassification 9>1 9>2
IFCPROPERTYSET('g',$,'n',$,(#1,#2)) hasProperty 9>1 9>2
IFCELEMENTQUANTITY('g',$,'n',$,$,(#1,#2)) hasQuantity 9>1 9>2
IFCPROPERTYSETTEMPLATE('g',$,'n',$,$,$,(#1,#2)) hasTemplate 9>1 9>2
IFCCOMPLEXPROPERTY('n',$,'u',(#1,#2)) hasProperty 9>1 9>2
IFCAPPROVALRELATIONSHIP('n',$,#1,#2) relatedApproval 9>1 relatingApproval 9>2
IFCCLASSIFICATIONREFERENCE($,'c','n',#1,$,$) hasClassificationReference 1>9
IFCDOORTYPE('g',$,'n',$,$,(#1,#2),$,$,$,.DOOR.,$,$,$) hasPropertySet 9>1 9>2
IFCWINDOWSTYLE('g',$,'n',$,$,(#1,#2),$,$,.WOOD.,.SINGLE_PANEL.,.F.,.F.) hasPropertySet 9>1 9>2
IFCSHAPEREPRESENTATION(#1,'Body','Brep',(#2)) none
""".strip().splitlines()


def _edge_cases() -> list[tuple[int, str, list[tuple[int, str, int]]]]:
    out = []
    for number, case in enumerate(EDGE_CASES):
        end = case.rindex(") ") + 1
        predicate, made = "", []
        for word in case[end:].split():
            if ">" in word:
                made.append((int(word.split(">")[0]), predicate, int(word.split(">")[1])))
            else:
                predicate = word
        out.append((number, case[:end], made))
    return out


@register(
    "edges_each_rule",
    "SELECT r_regionkey, t.col0 AS rule, t.col1 AS subject, t.col2 AS predicate, t.col3 AS object FROM region, (VALUES "
    + ", ".join(f"({n}, {s}, '{p}', {o})" for n, _, made in _edge_cases() for s, p, o in made)
    + ") t",
)
def edges_each_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    walls = "\n".join(f"#{k}=IFCWALL('g',$,'w',$,$,$,$,$,$);" for k in (1, 2, 3))
    texts = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(f"DATA;\n{walls}\n#9={line};").alias("text")) for n, line, _ in _edge_cases()])
    models = table(spark, sf_dir, "region").select("r_regionkey", F.explode(texts).alias("t")).select(F.concat_ws("-", "r_regionkey", "t.rule").alias("model_id"), "t.text")
    key, rule = (F.split("model_id", "-")[k].cast("int") for k in (0, 1))
    return edges.named_edges(step.records(models)).select(key.alias("r_regionkey"), rule.alias("rule"), "subject", "predicate", "object")


@register(
    "ingest_predefined_types",
    _per_supplier(
        [
            (1, "IFCSTAIRFLIGHT", "Flight", "STRAIGHT"), (2, "IFCFURNITURETYPE", "Chair", "CHAIR"), (3, "IFCTASK", "Task", "LOGISTIC"), (4, "IFCSPACE", "Room", "INTERNAL"),
            (5, "IFCPILE", "Pile", "DRIVEN"), (6, "IFCREINFORCINGBAR", "Bar", "MAIN"), (7, "IFCDOORTYPE", "Doors", "GATE"), (8, "IFCNOSUCHCLASS", None, None),
        ],
        "t.col0 AS entity_id, t.col1 AS ifc_type, t.col2 AS name, t.col3 AS predefined_type",
    ),
)
def ingest_predefined_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by their place in each class; a class that the schema lacks gets no guessed names."""
    lines = [
        "#1=IFCSTAIRFLIGHT('g',$,'Flight',$,$,$,$,$,12,11,0.18,0.27,.STRAIGHT.);",
        "#2=IFCFURNITURETYPE('g',$,'Chair',$,$,$,$,$,$,.FACTORY.,.CHAIR.);",
        "#3=IFCTASK('g',$,'Task',$,$,'T1',$,$,$,.F.,$,$,.LOGISTIC.);",
        "#4=IFCSPACE('g',$,'Room',$,$,$,$,'Long room',.ELEMENT.,.INTERNAL.,$);",
        "#5=IFCPILE('g',$,'Pile',$,$,$,$,$,.DRIVEN.,$);",
        "#6=IFCREINFORCINGBAR('g',$,'Bar',$,$,$,$,$,$,0.012,0.0001,$,.MAIN.,$);",
        "#7=IFCDOORTYPE('g',$,'Doors',$,$,$,$,$,$,.GATE.,$,$,$);",
        "#8=IFCNOSUCHCLASS('g',$,'x',$,$,$,$,$,.NOTHING.);",
    ]
    rows = ingest.ingest(suppliers_as_models(spark, sf_dir, lines)).entities
    return rows.select("model_id", "entity_id", "ifc_type", "name", "predefined_type")


@register(
    "ingest_older_schema",
    _per_supplier([(1, "Room", "ElevationWithFlooring", "0.5"), (2, "Stair", "ShapeType", "STRAIGHT"), (3, None, "ItemReference", "C1")], "t.col0 AS entity_id, t.col1 AS name, t.col2 AS attr_name, t.col3 AS value"),
)
def ingest_older_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the schema that the file's header states."""
    lines = ["#1=IFCSPACE('g',$,'Room',$,$,$,$,$,.ELEMENT.,.INTERNAL.,0.5);", "#2=IFCSTAIR('g',$,'Stair',$,$,$,$,$,.STRAIGHT.);", "#3=IFCCLASSIFICATIONREFERENCE('l','C1',$,$);"]
    tables = ingest.ingest(suppliers_as_models(spark, sf_dir, lines, "IFC2X3"))
    rows = tables.attributes.where(F.col("attr_name").isin("ElevationWithFlooring", "ShapeType", "ItemReference"))
    return rows.join(tables.entities, ["model_id", "entity_id"]).select("model_id", "entity_id", "name", "attr_name", "value")


@register(
    "ingest_quantities",
    """SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS model_id, t.col0 AS property_name, s_suppkey::DOUBLE AS value_num, s_suppkey::DOUBLE * t.col1 AS value_si, t.col2 AS unit, t.col3 AS data_type
       FROM supplier, (VALUES ('Length', 0.001::DOUBLE, 'MILLIMETRE', 'IFCLENGTHMEASURE'), ('Area', 1::DOUBLE, NULL, 'IFCAREAMEASURE'), ('Weight', 1000::DOUBLE, 'KILOGRAM', 'IFCMASSMEASURE'),
         ('Count', 1::DOUBLE, NULL, 'IFCCOUNTMEASURE'), ('Own', 1::DOUBLE, 'METRE', 'IFCLENGTHMEASURE')) t""",
)
def ingest_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        "#1=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);", "#2=IFCSIUNIT(*,.MASSUNIT.,.KILO.,.GRAM.);", "#3=IFCUNITASSIGNMENT((#1,#2));", "#4=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);",
        "#10=IFCWALL('g',$,'Wall',$,$,$,$,$,$);", "#11=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#10),#12);", "#12=IFCELEMENTQUANTITY('g',$,'Qto_Wall',$,$,(#13,#14,#15,#16,#17));",
        "#13=IFCQUANTITYLENGTH('Length',$,$,{key}.,$);", "#14=IFCQUANTITYAREA('Area',$,$,{key}.,$);", "#15=IFCQUANTITYWEIGHT('Weight',$,$,{key}.,$);",
        "#16=IFCQUANTITYCOUNT('Count',$,$,{key},$);", "#17=IFCQUANTITYLENGTH('Own',$,#4,{key}.,$);",
    ]
    rows = ingest.ingest(suppliers_as_models(spark, sf_dir, lines)).properties
    return rows.select("model_id", "property_name", "value_num", "value_si", "unit", "data_type")


_DISPLAY = [
    "#1=IFCPROPERTYENUMERATEDVALUE('E',$,(IFCLABEL('a'),IFCLABEL('b'),$),$);",
    "#2=IFCPROPERTYLISTVALUE('L',$,(IFCREAL(1.),IFCREAL(2.)),.MILLI.);",
    "#3=IFCPROPERTYBOUNDEDVALUE('B',$,IFCREAL(3.),IFCREAL(1.),#9,$);",
    "#4=IFCPROPERTYBOUNDEDVALUE('B',$,$,IFCREAL(1.),$,$);",
    "#5=IFCPROPERTYTABLEVALUE('T',$,(IFCREAL(1.)),(IFCREAL(5.)),$,$,$,$);",
    "#6=IFCPROPERTYREFERENCEVALUE('R',$,'usage',#9);",
    "#7=IFCCOMPLEXPROPERTY('C',$,'kind',(#1));",
    "#8=IFCPROPERTYLISTVALUE('L',$,(),$);",
]


@register(
    "ingest_display_values",
    _per_supplier(
        [(1, "a, b", None), (2, "1., 2.", "MILLI"), (3, "1. … 3.", None), (4, "1. … +∞", None), (5, "1.", None), (6, "usage", None), (7, "kind", None), (8, None, None)],
        "t.col0 AS prop_id, t.col1 AS value, t.col2 AS unit",
    ),
)
def ingest_display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.display_values(suppliers_as_models(spark, sf_dir, _DISPLAY))


@register(
    "ingest_raw_attributes",
    _per_supplier(
        [
            (0, "Identification", None, "P", None), (1, "FamilyName", None, None, None), (2, "GivenName", None, "x", None), (3, "MiddleNames", None, "a, b, c, d (+2)", 6), (4, "PrefixTitles", None, "()", 0),
            (5, "SuffixTitles", None, None, None), (6, "Roles", None, "#7, $, (…)", 3), (7, "Addresses", 8, "#8", None),
        ],
        "t.col0 AS pos, t.col1 AS attr_name, t.col2 AS ref, t.col3 AS value, t.col4 AS n",
    ),
)
def ingest_raw_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = suppliers_as_models(spark, sf_dir, ["#1=IFCPERSON('P',$,'x',('a','b','c','d','e','f'),(),$,(#7,$,(#8)),#8);"])
    rows = ingest.raw_attributes(ingest.named_arguments(records))
    return rows.select("model_id", "pos", "attr_name", "ref", "value", F.when(F.col("values").isNotNull(), F.size("values")).alias("n"))


@register("ingest_attributes", _per_customer("('Identification', 'P'), ('FamilyName', ''), ('GivenName', 'x'), ('GivenName', 'y'), ('MiddleNames', ''), ('PrefixTitles', ''), ('SuffixTitles', ''), ('Roles', ''), ('Addresses', '')", "t.col0 AS attr_name, t.col1 AS value"))
def ingest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.named_arguments(model_records(spark, sf_dir)).where("ifc_type = 'IFCPERSON'")
    return ingest.attribute_rows(rows).select("model_id", "attr_name", "value")


@register(
    "mesh_statistics",
    """SELECT CAST(o_custkey AS INT) AS entity_id, (4 * count(*))::INT AS vertex_count, (2 * count(*))::INT AS triangle_count, (4 * count(DISTINCT o_orderkey % 3))::INT AS unique_vertex_count, count(*)::INT AS mesh_part_count,
       min(o_orderkey % 97 + 10.0)::DOUBLE AS bbox_min_x, max(2.0 * (o_orderkey % 89) + 20.0)::DOUBLE AS bbox_max_y FROM orders GROUP BY o_custkey""",
)
def mesh_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("m").alias("model_id"), F.col("o_custkey").cast("int").alias("entity_id"), "o_orderkey")
    move = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1, 0, 10, 20, 30, 1)])
    vertices = orders.select("model_id", "entity_id", (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"), F.lit(0.0).alias("z"), move.alias("m"))
    parts = orders.select("model_id", "entity_id", (F.col("o_orderkey") % 3).alias("geometry_id"), F.lit(4).alias("n_vertices"), F.lit(2).alias("n_triangles"))
    return edges.mesh_statistics(vertices, parts).select("entity_id", "vertex_count", "triangle_count", "unique_vertex_count", "mesh_part_count", "bbox_min_x", "bbox_max_y")


@register("content_hash", "SELECT doc_id, sha256(text) AS model_id FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", step.content_id(F.col("text")).alias("model_id"))


@register("number_text", f"SELECT event_id, {sql_number('event_type')} AS a, {sql_number('CAST(event_id AS VARCHAR)')} AS b FROM events")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", number(F.col("event_type")).alias("a"), number(F.col("event_id").cast("string")).alias("b"))

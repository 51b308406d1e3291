"""Records to base tables: named attributes, units, property rows.

Records, named arguments and edges are written once; the tables are plans over these files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.guid import canonical
from girder.functions.numbers import script_number
from girder.functions.units import MEASURE_UNIT_TYPE, QUANTITY_UNIT_TYPE, lookup, measure_unit_type, si_factor, unit_label
from girder.operators.edges import edges_of, edges_of_written, kept_records
from girder.schema import ATTRIBUTES, BOX, ENTITIES, MESH, PROPERTIES, TIER1, TRIPLES, ModelTables
from girder.scratch import Scratch, growing
from girder.sources.ifc_schema import LATEST, Table, tables
from girder.sources.step import cast_name, decode_arg, is_empty_text, list_refs, ref_id

_NAMES = ["Name", "GlobalId", "Description", "ObjectType", "Tag", "PredefinedType", "LongName", "Identification"]
# Property sets without property records, and attributes of those that are no property.
PREDEFINED_SETS = (
    "IFCDOORLININGPROPERTIES", "IFCDOORPANELPROPERTIES", "IFCPERMEABLECOVERINGPROPERTIES",
    "IFCREINFORCEMENTDEFINITIONPROPERTIES", "IFCWINDOWLININGPROPERTIES", "IFCWINDOWPANELPROPERTIES",
)
BOOKKEEPING = ("globalid", "ownerhistory", "name", "description")
#: Multi-valued properties: class, argument of the values, argument of their unit. Complex properties, complex quantities and reference
#: values have no row of their own.
MULTI = (
    ("IFCPROPERTYENUMERATEDVALUE", 2, None), ("IFCPROPERTYLISTVALUE", 2, 3),
    ("IFCPROPERTYBOUNDEDVALUE", 2, 4), ("IFCPROPERTYBOUNDEDVALUE", 3, 4), ("IFCPROPERTYBOUNDEDVALUE", 5, 4),
    ("IFCPROPERTYTABLEVALUE", 2, 5), ("IFCPROPERTYTABLEVALUE", 3, 6),
)


def named_arguments(records: DataFrame, given: Mapping[str, Table] | None = None) -> DataFrame:
    """(model_id, entity_id, ifc_type, ord, pos, attr_name, raw, members): one row per argument of every kept record.

    A class's names come from the table of its file's schema (of those in ``given`` first, else the built-in one, else the latest);
    a class that the table lacks, and arguments beyond its names, are ``[n]``.
    """
    known = {**tables(), **(given or {})}
    names = records.sparkSession.createDataFrame([(schema, kind, list(names)) for schema, table in known.items() for kind, names in table.items()], "known string, ifc_type string, names array<string>")
    rows = kept_records(records).select(
        "model_id", "entity_id", "ifc_type", "ord", F.when(F.col("schema").isin(*known), F.col("schema")).otherwise(LATEST).alias("known"), F.arrays_zip("arg_list", "members").alias("args")
    )
    rows = rows.join(F.broadcast(names), ["known", "ifc_type"], "left")  # a table of constants
    rows = rows.select("model_id", "entity_id", "ifc_type", "ord", "names", F.posexplode("args").alias("pos", "arg"))
    named = F.coalesce(F.get("names", F.col("pos")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    return rows.select("model_id", "entity_id", "ifc_type", "ord", "pos", named.alias("attr_name"), F.col("arg.arg_list").alias("raw"), F.col("arg.members").alias("members"))


def entity_rows(records: DataFrame, arguments: DataFrame, mesh: DataFrame | None = None) -> DataFrame:
    """The entities table: Tier-1 columns by attribute name, with null for absent or blank ones."""
    pick = lambda name: F.max(F.when(F.col("attr_name") == name, F.struct("raw"))).getField("raw")
    wide = arguments.where(F.col("attr_name").isin(_NAMES)).groupBy("model_id", "entity_id").agg(
        *[pick(n).alias(TIER1[n.lower()]) for n in _NAMES]
    )
    rows = kept_records(records).select("model_id", "entity_id", "ifc_type").join(growing(wide), ["model_id", "entity_id"], "left")
    blank = F.filter(F.array(*[F.when(is_empty_text(F.col(c)), F.lit(n)) for n, c in TIER1.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("empty_attrs", F.when(F.size(blank) > 0, F.concat(F.lit(","), F.array_join(blank, ","), F.lit(","))))
    rows = rows.withColumns({c: F.when(ref_id(F.col(c)).isNull(), decode_arg(F.col(c))) for c in TIER1.values()})
    rows = rows.withColumn("global_id_canonical", canonical(F.col("global_id")))
    if mesh is not None:
        rows = rows.join(growing(mesh), ["model_id", "entity_id"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None) for c in (*BOX, *MESH)})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in ENTITIES.fields])


def attribute_rows(arguments: DataFrame) -> DataFrame:
    """The attributes table: one row per member of a list, else one; absent values are empty text, references ``#id``."""
    rows = arguments.where(~F.startswith("attr_name", F.lit("[")))
    rows = rows.select("model_id", "entity_id", "attr_name", F.col("members").isNotNull().alias("many"), F.explode(F.coalesce("members", F.array("raw"))).alias("raw"))
    rows = rows.select("model_id", "entity_id", "attr_name", "many", F.coalesce(decode_arg(F.col("raw")), F.lit("")).alias("value"))
    return rows.where(~F.col("many") | (F.col("value") != "")).drop("many")


def raw_attributes(arguments: DataFrame) -> DataFrame:
    """(model_id, entity_id, pos, attr_name, ref, value, values): every argument for display.

    Of a list, ``values`` has all members and ``value`` the first four with the number of the others.
    """
    member = lambda m: F.when(F.startswith(m, F.lit("(")), "(…)").otherwise(F.coalesce(decode_arg(m), F.lit("$")))
    rows = arguments.withColumn("values", F.transform("members", member))
    more = F.size("values") - 4
    shown = F.concat(F.array_join(F.slice("values", 1, 4), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))
    listed = F.when(F.size("values") == 0, "()").otherwise(shown)
    value = F.when(F.col("values").isNotNull(), listed).otherwise(decode_arg(F.col("raw")))
    return rows.select("model_id", "entity_id", "pos", "attr_name", ref_id(F.col("raw")).alias("ref"), value.alias("value"), "values")


def display_values(records: DataFrame) -> DataFrame:
    """(model_id, prop_id, value, unit): one text for each property that is no single value, as panels show it."""
    arg = lambda k: F.get("arg_list", F.lit(k))
    joined = F.nullif(F.array_join(F.filter(F.transform(F.get("members", F.lit(2)), decode_arg), lambda v: v.isNotNull()), ", "), F.lit(""))
    low, high = decode_arg(arg(3)), decode_arg(arg(2))
    bounds = F.when(low.isNotNull() | high.isNotNull(), F.concat(F.coalesce(low, F.lit("−∞")), F.lit(" … "), F.coalesce(high, F.lit("+∞"))))
    kind = F.col("ifc_type")
    value = (
        F.when(kind.isin("IFCPROPERTYENUMERATEDVALUE", "IFCPROPERTYLISTVALUE", "IFCPROPERTYTABLEVALUE"), joined)
        .when(kind == "IFCPROPERTYBOUNDEDVALUE", bounds)
        .when(kind.isin("IFCPROPERTYREFERENCEVALUE", "IFCCOMPLEXPROPERTY"), decode_arg(arg(2)))
    )
    unit = F.when(kind == "IFCPROPERTYLISTVALUE", arg(3)).when(kind == "IFCPROPERTYBOUNDEDVALUE", arg(4))
    unit = F.when(~F.startswith(unit, F.lit("#")), decode_arg(unit))
    shown = ("IFCPROPERTYENUMERATEDVALUE", "IFCPROPERTYLISTVALUE", "IFCPROPERTYTABLEVALUE", "IFCPROPERTYBOUNDEDVALUE", "IFCPROPERTYREFERENCEVALUE", "IFCCOMPLEXPROPERTY")
    return records.where(kind.isin(*shown)).select("model_id", F.col("entity_id").alias("prop_id"), value.alias("value"), unit.alias("unit"))


def _argument(records: DataFrame, kind: str, *wanted: tuple[int, str]) -> DataFrame:
    return records.where(F.col("ifc_type") == kind).select("model_id", F.col("entity_id").alias("unit_id"), "ord", *[F.get("arg_list", F.lit(k)).alias(n) for k, n in wanted])


def unit_table(records: DataFrame) -> DataFrame:
    """(model_id, unit_id, unit_type, label, factor) of SI and conversion-based units."""
    si = _argument(records, "IFCSIUNIT", (1, "type"), (2, "prefix"), (3, "name"))
    name = F.coalesce(F.upper(decode_arg(F.col("name"))), F.lit("METRE"))
    prefix = decode_arg(F.col("prefix"))
    plain = si.select("model_id", "unit_id", decode_arg(F.col("type")).alias("unit_type"), unit_label(prefix, name).alias("label"), si_factor(prefix, name).alias("factor"))
    based = _argument(records, "IFCCONVERSIONBASEDUNIT", (1, "type"), (2, "name"), (3, "by")).withColumn("by", ref_id(F.col("by")))
    measures = _argument(records, "IFCMEASUREWITHUNIT", (0, "value"), (1, "unit"))
    measures = measures.select("model_id", F.col("unit_id").alias("by"), script_number(decode_arg(F.col("value"))).alias("times"), ref_id(F.col("unit")).alias("base"))
    bases = plain.select("model_id", F.col("unit_id").alias("base"), F.col("factor").alias("of"))
    joined = based.join(growing(measures), ["model_id", "by"], "left").join(growing(bases), ["model_id", "base"], "left")
    factor = F.when(F.col("times").isNull(), 1.0).otherwise(F.col("times") * F.coalesce("of", F.lit(1.0)))
    converted = joined.select("model_id", "unit_id", decode_arg(F.col("type")).alias("unit_type"), F.coalesce(decode_arg(F.col("name")), F.lit("UNIT")).alias("label"), factor.alias("factor"))
    return plain.unionByName(converted)


def default_units(records: DataFrame, units: DataFrame) -> DataFrame:
    """(model_id, unit_type, label, factor) of the assigned units; of several of a type the last one counts."""
    assigned = records.where("ifc_type = 'IFCUNITASSIGNMENT'").select("model_id", "ord", F.posexplode(list_refs(F.get("arg_list", F.lit(0)))).alias("at", "unit_id"))
    found = assigned.join(growing(units), ["model_id", "unit_id"]).where("unit_type IS NOT NULL")
    last = found.groupBy("model_id", "unit_type").agg(F.max_by(F.struct("label", "factor"), F.struct("ord", "at")).alias("u"))
    return last.select("model_id", "unit_type", "u.label", "u.factor")


def authored_values(records: DataFrame) -> DataFrame:
    """(model_id, prop_id, property_name, value, measure, unit_ref, unit_type) of every value of every supported property.

    A record gives an array of (value, measure, unit type, unit), so all kinds of property come from one pass.
    """
    arg = lambda k: F.get("arg_list", F.lit(k))
    kind = F.col("ifc_type")

    def entry(raw: Column, measure: Column, unit_type: Column, unit: Column) -> Column:
        return F.struct(raw.alias("raw"), measure.alias("measure"), unit_type.alias("unit_type"), unit.alias("unit_ref"))

    none = F.lit(None).cast("int")
    quantity_measure = F.replace(F.concat(F.lit("IFC"), F.regexp_extract(kind, "^IFCQUANTITY(.*)$", 1), F.lit("MEASURE")), F.lit("WEIGHT"), F.lit("MASS"))
    single = F.array(entry(arg(2), cast_name(arg(2)), lookup(MEASURE_UNIT_TYPE, cast_name(arg(2))), ref_id(arg(3))))
    quantity = F.array(entry(arg(3), quantity_measure, lookup(QUANTITY_UNIT_TYPE, kind), ref_id(arg(2))))
    made = F.when(kind == "IFCPROPERTYSINGLEVALUE", single).when(F.startswith(kind, F.lit("IFCQUANTITY")), quantity)
    for of in dict.fromkeys(k for k, _, _ in MULTI):
        parts = []
        for _, values, unit in (rule for rule in MULTI if rule[0] == of):
            several = F.coalesce(F.get("members", F.lit(values)), F.array(arg(values)))
            of_unit = ref_id(arg(unit)) if unit is not None else none
            own = F.transform(several, lambda raw, of_unit=of_unit: entry(raw, cast_name(raw), measure_unit_type(cast_name(raw)), of_unit))
            parts.append(F.filter(own, lambda e: decode_arg(e["raw"]).isNotNull()))
        made = made.when(kind == of, F.concat(*parts))
    rows = records.where(F.startswith(kind, F.lit("IFCPROPERTY")) | F.startswith(kind, F.lit("IFCQUANTITY")))
    rows = rows.select("model_id", F.col("entity_id").alias("prop_id"), decode_arg(arg(0)).alias("property_name"), F.explode(made).alias("e"))
    return rows.select("model_id", "prop_id", "property_name", "e.unit_ref", "e.measure", "e.unit_type", decode_arg(F.col("e.raw")).alias("value"))


def with_units(values: DataFrame, records: DataFrame) -> DataFrame:
    """Values with value_num, value_si and unit: the named unit, else the model's default for the measure."""
    units = unit_table(records)
    explicit = units.select("model_id", F.col("unit_id").alias("unit_ref"), F.col("label").alias("own_label"), F.col("factor").alias("own_factor"))
    joined = values.join(growing(explicit), ["model_id", "unit_ref"], "left").join(growing(default_units(records, units)), ["model_id", "unit_type"], "left")
    number = script_number(F.col("value"))
    return joined.withColumns({"value_num": number, "value_si": number * F.coalesce("own_factor", "factor", F.lit(1.0)), "unit": F.coalesce("own_label", "label")})


def property_rows(records: DataFrame, entities: DataFrame, triples: DataFrame, arguments: DataFrame) -> DataFrame:
    """The properties table: element to property set to property, one row per value."""
    sets = edges_of(triples, "IfcRelDefinesByProperties", "hasPropertySet").select("model_id", F.col("subject").alias("entity_id"), F.col("object").alias("set_id"))
    named = entities.select("model_id", F.col("entity_id").alias("set_id"), F.coalesce("name", "ifc_type").alias("pset_name"), F.upper("ifc_type").alias("set_type"))
    owned = sets.join(growing(named), ["model_id", "set_id"])
    members = edges_of(triples, "hasProperty", "hasQuantity").select("model_id", F.col("subject").alias("set_id"), F.col("object").alias("prop_id"))
    values = with_units(authored_values(records), records).where("property_name IS NOT NULL")
    listed = owned.where(~F.col("set_type").isin(*PREDEFINED_SETS)).join(growing(members), ["model_id", "set_id"]).join(growing(values), ["model_id", "prop_id"])
    listed = listed.withColumn("data_type", F.col("measure"))
    own = attribute_rows(arguments.where(F.col("ifc_type").isin(*PREDEFINED_SETS) & ~F.lower("attr_name").isin(*BOOKKEEPING)))
    own = own.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select("model_id", F.col("entity_id").alias("set_id"), F.col("attr_name").alias("property_name"), "value")
    fixed = owned.where(F.col("set_type").isin(*PREDEFINED_SETS)).join(growing(own), ["model_id", "set_id"])
    number = script_number(F.col("value"))
    fixed = fixed.withColumns({"value_num": number, "value_si": number, "unit": F.lit(None).cast("string"), "data_type": F.lit(None).cast("string")})
    names = [f.name for f in PROPERTIES.fields]
    return listed.select(*names).unionByName(fixed.select(*names))


def ingest(records: DataFrame, profile: str = "learning", given: Mapping[str, Table] | None = None, mesh: DataFrame | None = None) -> ModelTables:
    """Base tables of all models in ``records``; ``given`` has attribute names by schema that go before the built-in ones."""
    scratch = Scratch(records.sparkSession, "ingest")
    records = scratch.save(records, "records")
    arguments = scratch.save(named_arguments(records, given), "arguments")
    entities = entity_rows(records, arguments, mesh)
    triples = scratch.save(edges_of_written(records, scratch, profile).select(*[f.name for f in TRIPLES.fields]), "triples")
    return ModelTables(entities, triples, property_rows(records, entities, triples, arguments), attribute_rows(arguments).select(*[f.name for f in ATTRIBUTES.fields]))

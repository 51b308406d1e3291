"""Facets as flag columns: every facet of a specification in one scan of the relation that it reads.

Quantifiers become aggregations (``bool_or``, ``bool_and``), existence becomes a left join with ``coalesce(false)``;
no correlated subquery is ever planned. The relations are first cut to the entities in scope by a semi join on
``(model_id, entity_id)``, whose partitioning the aggregations and the final join then share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.units import MEASURE_UNIT_TYPE
from girder.plans.restrictions import matches, matches_measure, never
from girder.plans.rules import Attribute, Classification, Entity, Facet, Material, PartOf, Property, Simple
from girder.schema import KEY, TIER1, ModelTables

#: The relationships that part-of walks when none is named.
PART_OF_RELATIONS = (
    "IfcRelAggregates",
    "IfcRelAssignsToGroup",
    "IfcRelContainedInSpatialStructure",
    "IfcRelNests",
    "IfcRelVoidsElement",
    "IfcRelFillsElement",
)
PART_OF_DEPTH = 8


@dataclass(frozen=True)
class Ask:
    """One column to make: whether a facet holds (test), whether its subject is there (anchor), or its value (value)."""

    column: str
    facet: Facet
    what: str = "test"


def tier1_column(facet: Attribute) -> Column | None:
    """The entity column that the facet's name stands for, in any case."""
    column = TIER1.get(facet.name.value.lower()) if isinstance(facet.name, Simple) else None
    return F.col(column) if column else None


def _filled(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def _known(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def direct_column(ask: Ask) -> Column | None:
    """The column of an ask that the entity row itself answers; None if another relation is needed."""
    facet = ask.facet
    if isinstance(facet, Entity):
        name = matches(F.col("ifc_type"), facet.name)
        if ask.what == "value":
            return None
        if facet.predefined_type is None:
            return name
        by_enum = matches(F.col("pt_enum"), facet.predefined_type)
        by_text = (F.upper("pt_enum") == "USERDEFINED") & F.col("pt_user").isNotNull() & matches(F.col("pt_user"), facet.predefined_type)
        return name & (by_enum | by_text)
    if isinstance(facet, Attribute):
        column = tier1_column(facet)
        if column is not None:
            if ask.what == "value":
                return column
            if ask.what == "anchor":
                return column.isNotNull() | F.contains(F.coalesce("empty_attrs", F.lit("")), F.lit(f",{facet.name.value.lower()},"))
            return _filled(column) if facet.value is None else _filled(column) & matches(column, facet.value)
        if facet.name == Simple(""):
            return never()
    return None


def has_value(facet: Facet) -> bool:
    """Whether a single value of an entity can be named for the facet."""
    return isinstance(facet, Property) or isinstance(facet, Attribute) and isinstance(facet.name, Simple) and facet.name.value != ""


class FacetPlanner:
    """Adds the asked columns to a frame of entities."""

    def __init__(self, tables: ModelTables):
        self.tables, self.views = tables, tables.views

    def attach(self, entities: DataFrame, asks: list[Ask]) -> DataFrame:
        """``entities`` with one column per ask; tests and anchors are never null."""
        if any(isinstance(a.facet, Entity) and a.facet.predefined_type is not None for a in asks):
            entities = entities.join(self.views.predefined_types, KEY, "left")
        scope = entities.select(*KEY)
        pending: dict[type, list[Ask]] = {}
        direct: dict[str, Column] = {}
        for ask in asks:
            column = direct_column(ask)
            if column is None:
                pending.setdefault(type(ask.facet), []).append(ask)
            else:
                direct[ask.column] = column if ask.what == "value" else _known(column)
        out = entities.withColumns(direct) if direct else entities
        makers = {Attribute: self._attributes, Property: self._properties, Classification: self._classifications, Material: self._materials, PartOf: self._part_of}
        for kind, own in pending.items():
            out = out.join(makers[kind](scope, own), KEY, "left")
            out = out.withColumns({a.column: _known(F.col(a.column)) for a in own if a.what != "value"})
        return out

    def _attributes(self, scope: DataFrame, asks: list[Ask]) -> DataFrame:
        rows = self.tables.attributes
        tests: dict[str, Column] = {}
        made: list[Column] = []
        for a in asks:
            facet, value = a.facet, F.col("value")
            named = F.lower("attr_name") == facet.name.value.lower() if isinstance(facet.name, Simple) else matches(F.col("attr_name"), facet.name)
            if a.what == "value":
                made.append(F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(named, value))), ", "), F.lit("")).alias(a.column))
            elif a.what == "anchor" and isinstance(facet.name, Simple):
                tests[a.column] = named & value.isNotNull()
            elif a.what == "anchor" or facet.value is None:
                tests[a.column] = named & _filled(value)
            else:
                tests[a.column] = named & _filled(value) & matches(value, facet.value)
            tests.setdefault(f"{a.column}?", named)
        made += [F.bool_or(_known(tests[a.column])).alias(a.column) for a in asks if a.what != "value"]
        wanted = reduce(or_, [_known(t) for t in tests.values()])
        return rows.where(wanted).join(scope, KEY, "left_semi").groupBy(*KEY).agg(*made)

    def _properties(self, scope: DataFrame, asks: list[Ask]) -> DataFrame:
        """For every matching set there is a matching property, and every matching property has a value that does."""
        rows = self.views.effective_properties
        flags: dict[str, Column] = {}
        for a in asks:
            facet = a.facet
            flags[f"{a.column}_s"] = _known(matches(F.col("pset_name"), facet.property_set))
            flags[f"{a.column}_n"] = _known(matches(F.col("property_name"), facet.base_name))
            flags[f"{a.column}_v"] = _known(value_holds(facet) if a.what == "test" else _filled(F.col("value")))
        wanted = reduce(or_, [_known(matches(F.col("pset_name"), a.facet.property_set)) for a in asks])
        marked = rows.where(wanted).join(scope, KEY, "left_semi").withColumns(flags)
        tests = [a for a in asks if a.what != "value"]
        first = [F.bool_or(F.col(f"{a.column}_s")).alias(f"{a.column}_s") for a in tests] + [F.bool_or(f"{a.column}_n").alias(f"{a.column}_n") for a in tests]
        first += [F.bool_or(f"{a.column}_v").alias(f"{a.column}_v") for a in tests]
        order = F.struct("pset_name", "property_name", "value")
        seen = [F.min(F.when(F.col(f"{a.column}_s") & F.col(f"{a.column}_n"), order)).alias(a.column) for a in asks if a.what == "value"]
        by_property = marked.groupBy(*KEY, "pset_name", "property_name").agg(*(first + seen))
        second = []
        for a in tests:
            second.append(F.bool_or(f"{a.column}_s").alias(f"{a.column}_s"))
            second.append(F.bool_or(f"{a.column}_n").alias(f"{a.column}_n"))
            second.append(F.bool_and(~F.col(f"{a.column}_n") | F.col(f"{a.column}_v")).alias(f"{a.column}_v"))
        second += [F.min(a.column).alias(a.column) for a in asks if a.what == "value"]
        by_set = by_property.groupBy(*KEY, "pset_name").agg(*second)
        third = [F.bool_or(f"{a.column}_s").alias(f"{a.column}_s") for a in tests]
        third += [F.bool_and(~F.col(f"{a.column}_s") | (F.col(f"{a.column}_n") & F.col(f"{a.column}_v"))).alias(f"{a.column}_v") for a in tests]
        third += [F.min(a.column).alias(a.column) for a in asks if a.what == "value"]
        whole = by_set.groupBy(*KEY).agg(*third)
        return whole.select(*KEY, *[(F.col(f"{a.column}_s") & F.col(f"{a.column}_v")).alias(a.column) if a.what != "value" else F.col(f"{a.column}.value").alias(a.column) for a in asks])

    def _exists(self, rows: DataFrame, scope: DataFrame, tests: dict[str, Column]) -> DataFrame:
        wanted = reduce(or_, [_known(t) for t in tests.values()])
        return rows.where(wanted).join(scope, KEY, "left_semi").groupBy(*KEY).agg(*[F.bool_or(_known(t)).alias(c) for c, t in tests.items()])

    def _classifications(self, scope: DataFrame, asks: list[Ask]) -> DataFrame:
        tests = {}
        for a in asks:
            parts = [F.lit(True)]
            if a.what == "test" and a.facet.system is not None:
                parts.append(matches(F.col("system"), a.facet.system))
            if a.what == "test" and a.facet.value is not None:
                parts.append(matches(F.col("code"), a.facet.value))
            tests[a.column] = reduce(and_, parts)
        return self._exists(self.views.classifications, scope, tests)

    def _materials(self, scope: DataFrame, asks: list[Ask]) -> DataFrame:
        tests = {}
        for a in asks:
            value = a.facet.value if a.what == "test" else None
            tests[a.column] = F.lit(True) if value is None else _known(matches(F.col("name"), value)) | _known(matches(F.col("category"), value))
        return self._exists(self.views.materials, scope, tests)

    def _part_of(self, scope: DataFrame, asks: list[Ask]) -> DataFrame:
        frames = []
        for relation in dict.fromkeys(a.facet.relation.lower() for a in asks):
            own = [a for a in asks if a.facet.relation.lower() == relation]
            wholes = ancestors(self.tables.triples, scope, relation)
            nodes = self.tables.entities.select("model_id", F.col("entity_id").alias("whole_id"), "ifc_type", "predefined_type", "object_type")
            joined = wholes if all(a.facet.entity is None for a in own) else wholes.join(nodes, ["model_id", "whole_id"], "left")
            tests = {}
            for a in own:
                whole, parts = a.facet.entity, [F.lit(True)]
                if whole is not None:
                    parts.append(matches(F.col("ifc_type"), whole.name))
                    if whole.predefined_type is not None:
                        by_text = (F.upper("predefined_type") == "USERDEFINED") & matches(F.col("object_type"), whole.predefined_type)
                        parts.append(_known(matches(F.col("predefined_type"), whole.predefined_type)) | _known(by_text))
                tests[a.column] = reduce(and_, parts)
            frames.append(joined.groupBy(*KEY).agg(*[F.bool_or(_known(t)).alias(c) for c, t in tests.items()]))
        return reduce(lambda x, y: x.join(y, KEY, "full"), frames)


def value_holds(facet: Property) -> Column:
    """Whether a property row has the data type and a value that the facet wants; a row without type passes for type."""
    parts = []
    if facet.data_type:
        parts.append(F.col("data_type").isNull() | (F.upper("data_type") == facet.data_type.upper()))
    if facet.value is None:
        parts.append(_filled(F.col("value")))
    elif facet.data_type and facet.data_type.upper() in MEASURE_UNIT_TYPE:
        parts.append(matches_measure(F.col("value_si"), facet.value))
    else:
        parts.append(matches(F.col("value"), facet.value, F.col("value_si")))
    return reduce(and_, parts)


def ancestors(triples: DataFrame, scope: DataFrame, relation: str = "", depth: int = PART_OF_DEPTH) -> DataFrame:
    """(model_id, entity_id, whole_id): the wholes of each entity in scope, up to ``depth`` edges above it.

    The walk starts at the wholes, which are few, as one row with a column per level; entities join its end.
    """
    allowed = F.lower("predicate") == relation.lower() if relation else F.col("predicate").isin(*PART_OF_RELATIONS)
    up = triples.where(allowed).select("model_id", F.col("object").alias("node"), F.col("subject").alias("whole_id")).distinct()
    walk = up.select("model_id", F.col("whole_id").alias("n0")).distinct()
    for k in range(depth - 1):
        walk = walk.join(up.select("model_id", F.col("node").alias(f"n{k}"), F.col("whole_id").alias(f"n{k + 1}")), ["model_id", f"n{k}"], "left")
    above = F.explode(F.array_distinct(F.array_compact(F.array(*[f"n{k}" for k in range(depth)])))).alias("whole_id")
    closure = walk.select("model_id", F.col("n0").alias("first"), above).distinct()
    own = scope.select("model_id", "entity_id", F.col("entity_id").alias("node")).join(up.withColumnRenamed("whole_id", "first"), ["model_id", "node"])
    return own.select("model_id", "entity_id", "first").join(closure, ["model_id", "first"]).select("model_id", "entity_id", "whole_id").distinct()

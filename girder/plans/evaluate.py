"""Specifications against models: one pass per group of specifications for all models, checks and verdicts as columns."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.functions.errors import SpecEvaluationError
from girder.plans.facets import Ask, FacetPlanner, direct_column, has_value
from girder.plans.rules import Document, Entity, Requirement, Specification
from girder.schema import KEY, ModelTables
from girder.scratch import Scratch

CHECK = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("requirement", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("found", T.StringType()),
        T.StructField("has_found", T.BooleanType()),
        T.StructField("passed", T.BooleanType()),
    ]
)
OUTCOME = "spec_id string, model_id string, entity_id int, uid string, ifc_type string, name string, checks array<struct<index:int,requirement:string,expected:string,found:string,has_found:boolean,passed:boolean>>"


#: Specifications that share one pass; more would make plans too wide to compile.
GROUP = 16
_ENTITY = (*KEY, "ifc_type", "name", "global_id", "description", "object_type", "tag", "predefined_type", "long_name", "identification", "empty_attrs")


def on_entity(ask: Ask) -> Column | None:
    """The ask's column if the entity row alone answers it, without the predefined type that counts for it."""
    facet = ask.facet
    return None if isinstance(facet, Entity) and facet.predefined_type is not None else direct_column(ask)


def requirement_asks(spec: Specification, prefix: str = "") -> list[Ask]:
    """req{k}, and val{k} and anc{k} where the requirement has them."""
    asks = []
    for k, requirement in enumerate(spec.requirements):
        asks.append(Ask(f"{prefix}req{k}", requirement.facet))
        if has_value(requirement.facet):
            asks.append(Ask(f"{prefix}val{k}", requirement.facet, "value"))
        if requirement.cardinality == "optional":
            asks.append(Ask(f"{prefix}anc{k}", requirement.facet, "anchor"))
    return asks


def spec_frame(tables: ModelTables, spec: Specification) -> DataFrame:
    """Applicable entities with req{i}, and val{i} and anc{i} where the requirement has them."""
    planner = FacetPlanner(tables)
    scope = [Ask(f"in{k}", f) for k, f in enumerate(spec.applicability)]
    plain = [a for a in scope if on_entity(a) is not None]
    entities = tables.entities.select(*_ENTITY)
    for ask in plain:  # what the entity row answers comes first, so everything else sees fewer entities
        entities = entities.where(direct_column(ask))
    rest = [a for a in scope if a not in plain]
    if rest:
        entities = planner.attach(entities, rest).where(reduce(and_, [F.col(a.column) for a in rest])).drop("pt_enum", "pt_user")
    asks = requirement_asks(spec)
    return planner.attach(entities, asks).select(*KEY, "ifc_type", "name", *[a.column for a in asks])


def verdict(requirement: Requirement, k: int, prefix: str = "") -> Column:
    """Whether the requirement is met: prohibited turns the test round, optional forgives an absent subject."""
    holds = F.col(f"{prefix}req{k}")
    if requirement.cardinality == "prohibited":
        return ~holds
    return holds | ~F.col(f"{prefix}anc{k}") if requirement.cardinality == "optional" else holds


def _check(requirement: Requirement, k: int, prefix: str) -> Column:
    found = F.col(f"{prefix}val{k}").cast("string") if has_value(requirement.facet) else F.lit(None).cast("string")
    return F.struct(
        F.lit(k).alias("index"),
        F.lit(requirement.label()).alias("requirement"),
        F.lit(requirement.expectation()).alias("expected"),
        found.alias("found"),
        F.lit(has_value(requirement.facet)).alias("has_found"),
        verdict(requirement, k, prefix).alias("passed"),
    )


def outcomes(tables: ModelTables, specs: Sequence[Specification]) -> DataFrame:
    """One row per specification and applicable entity with all its requirement checks, from one pass over each relation.

    Equal questions of several specifications are asked once.
    """
    planner = FacetPlanner(tables)
    entities = tables.entities.select(*_ENTITY)
    scopes: list[list[Ask]] = [[Ask(f"s{n}_in{k}", f) for k, f in enumerate(spec.applicability)] for n, spec in enumerate(specs)]
    wanted = [reduce(and_, [direct_column(a) for a in scope if on_entity(a) is not None], F.lit(True)) for scope in scopes]
    entities = entities.where(reduce(or_, [F.coalesce(w, F.lit(False)) for w in wanted]))
    asked: dict[tuple, str] = {}
    same: dict[str, str] = {}
    for ask in [a for n, spec in enumerate(specs) for a in (*scopes[n], *requirement_asks(spec, f"s{n}_"))]:
        same[ask.column] = asked.setdefault((ask.facet, ask.what), ask.column)
    made = planner.attach(entities, [Ask(column, *key) for key, column in asked.items()])
    made = made.withColumns({column: F.col(first) for column, first in same.items() if column != first})
    each = []
    for n, spec in enumerate(specs):
        checks = F.array(*[_check(r, k, f"s{n}_") for k, r in enumerate(spec.requirements)]) if spec.requirements else F.array()
        applies = reduce(and_, [F.col(a.column) for a in scopes[n]], F.lit(True))
        each.append(F.when(applies, F.struct(F.lit(spec.id).alias("spec_id"), checks.cast(T.ArrayType(CHECK)).alias("checks"))))
    made = made.select(*KEY, "ifc_type", "name", F.explode(F.array_compact(F.array(*each))).alias("s"))
    return made.select("s.spec_id", *KEY, F.concat_ws(":", *KEY).alias("uid"), "ifc_type", "name", "s.checks")


def cardinality(outcome: DataFrame, spec: Specification, per_model: DataFrame | None = None) -> DataFrame:
    """(spec_id, n_applicable, satisfied, reason) over all models, or per model_id of the frame ``per_model``."""
    counted = F.count("entity_id")
    if per_model is None:
        total = outcome.agg(counted.alias("n_applicable"))
    else:
        total = per_model.select("model_id").distinct().join(outcome.groupBy("model_id").agg(counted.alias("n_applicable")), "model_id", "left").withColumn("n_applicable", F.coalesce("n_applicable", F.lit(0)))
    n = F.col("n_applicable")
    if spec.cardinality == "prohibited":
        satisfied = n == 0
        said = F.concat(F.lit("Prohibited, but "), n.cast("string"), F.lit(" applicable entit"), F.when(n == 1, "y").otherwise("ies"), F.lit(" found."))
    elif spec.cardinality == "optional":
        satisfied, said = F.lit(True), F.lit(None).cast("string")
    else:
        satisfied, said = n > 0, F.lit("Required, but no applicable entity found in the model.")
    keys = [] if per_model is None else ["model_id"]
    return total.select(F.lit(spec.id).alias("spec_id"), *keys, "n_applicable", satisfied.alias("satisfied"), F.when(~satisfied, said).alias("reason"))


def evaluate_spec(tables: ModelTables, spec: Specification) -> DataFrame:
    """Outcomes of one specification; SpecEvaluationError if its rules cannot be planned."""
    try:
        return outcomes(tables, [spec])
    except Exception as error:
        raise SpecEvaluationError(f"{spec.id} ({spec.name}): {error}") from error


def evaluate_document(tables: ModelTables, document: Document, lenient: bool = False) -> dict[str, DataFrame]:
    """Outcomes of every specification by its id; those of a group are made in one pass and written.

    A specification that cannot be planned raises, or, if ``lenient``, has no outcomes and a warning says why.
    """
    good, results = [], {}
    for spec in document.specifications:
        try:
            evaluate_spec(tables, spec)
            good.append(spec)
        except SpecEvaluationError as error:
            if not lenient:
                raise
            warnings.warn(str(error), stacklevel=2)
            results[spec.id] = tables.spark.createDataFrame([], OUTCOME)
    scratch = Scratch(tables.spark, "outcomes")
    for at in range(0, len(good), GROUP):
        group = good[at : at + GROUP]
        made = scratch.save(outcomes(tables, group), str(at))
        results.update({spec.id: made.where(F.col("spec_id") == spec.id) for spec in group})
    return {spec.id: results[spec.id] for spec in document.specifications}


def check_ids(tables: ModelTables, xml: str | bytes, model_ids: list[str] | None = None, lenient: bool = False) -> tuple[Document, dict[str, DataFrame]]:
    """Read a requirement document and evaluate it on the given models (all by default)."""
    from girder.plans.rules import parse_ids

    document = parse_ids(xml)
    return document, evaluate_document(tables.where_models(model_ids), document, lenient)

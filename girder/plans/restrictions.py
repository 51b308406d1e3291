"""Value restrictions as Column predicates."""

from __future__ import annotations

import warnings
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from girder.functions.numbers import interval, literal, number
from girder.functions.xsd_pattern import checked
from girder.plans.rules import Bounds, Length, OneOf, Pattern, Restriction, Simple

def never() -> Column:
    return F.lit(False)


def _equals(text: Column, value: str, numeric: Column | None) -> Column:
    """Equality with a literal: exact text, ``true`` and ``false`` in any case, numbers within tolerance."""
    if value in ("true", "false"):
        return F.lower(text) == value
    spelled = literal(value)
    if spelled is None:
        return text == value
    low, high = interval(spelled, guarded=True)
    same = (text == value) | number(text).between(low, high)
    return same if numeric is None else same | numeric.between(low, high)


def _within(measure: Column, bounds: Bounds) -> Column:
    parts = []
    if bounds.low is not None:
        parts.append(measure >= bounds.low if bounds.low_included else measure > bounds.low)
    if bounds.high is not None:
        parts.append(measure <= bounds.high if bounds.high_included else measure < bounds.high)
    return reduce(and_, parts) if parts else measure.isNotNull()


def _sized(text: Column, length: Length) -> Column:
    tests = [text.isNotNull()]
    size = F.char_length(text)
    if length.exact is not None:
        tests.append(size == length.exact)
    if length.least is not None:
        tests.append(size >= length.least)
    if length.most is not None:
        tests.append(size <= length.most)
    return reduce(and_, tests)


def matches(text: Column, restriction: Restriction | None, numeric: Column | None = None, spark=None) -> Column:
    """Whether ``text`` satisfies the restriction; null where the comparison is unknown.

    numeric: the value as a number in SI units, if there is one beside the text.
    """
    match restriction:
        case None:
            return text.isNotNull()
        case Simple(value):
            return _equals(text, value, numeric)
        case OneOf(values):
            plain = [v for v in values if v not in ("true", "false") and literal(v) is None]
            tests = ([text.isin(plain)] if plain else []) + [_equals(text, v, numeric) for v in values if v not in plain]
            return reduce(or_, tests) if tests else never()
        case Pattern(pattern):
            from pyspark.sql import SparkSession

            return text.rlike(checked(spark or SparkSession.active(), pattern))
        case Length():
            return _sized(text, restriction)
        case Bounds():
            return _within(number(text) if numeric is None else numeric, restriction)
    raise TypeError(f"not a restriction: {restriction!r}")


def matches_measure(measure: Column, restriction: Restriction | None) -> Column:
    """Whether a number in SI units satisfies the restriction; text restrictions never do."""
    match restriction:
        case None:
            return measure.isNotNull()
        case Simple(value):
            spelled = literal(value)
            if spelled is None:
                warnings.warn(f"{value!r} is no number: a measure never equals it", stacklevel=2)
                return never()
            return measure.between(*interval(spelled, guarded=False))
        case OneOf(values):
            return reduce(or_, [matches_measure(measure, Simple(v)) for v in values], never())
        case Bounds():
            return _within(measure, restriction)
    warnings.warn(f"{restriction.label()} is a restriction of text: a measure never satisfies it", stacklevel=2)
    return never()

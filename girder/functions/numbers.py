"""Number parsing with the same results at every setting of the session."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LITERAL = re.compile(rf"\s*{NUMBER}\s*")
TOLERANCE = 1e-6
EPSILON = 2.0**-52


def number(text: Column) -> Column:
    """The double that a text spells, null for anything but a plain decimal number (no ``1d``, ``inf`` or ``nan``)."""
    return F.when(text.rlike(rf"\A\s*{NUMBER}\s*\z"), F.trim(text).try_cast("double"))


def script_number(text: Column) -> Column:
    """As :func:`number`, and also 0x, 0o and 0b integers; results that are not finite are null."""
    t = F.lower(F.trim(text))
    digits = F.substring(t, 3, F.length(t))
    based = [F.when(t.rlike(rf"\A0{mark}{digit}+\z"), F.conv(digits, base, 10).try_cast("double")) for mark, digit, base in (("x", "[0-9a-f]", 16), ("o", "[0-7]", 8), ("b", "[01]", 2))]
    found = F.coalesce(number(text), *based)
    return F.when(F.abs(found) < float("inf"), found)


def literal(text: str) -> float | None:
    """The finite number that a rule's literal spells."""
    if not _LITERAL.fullmatch(text):
        return None
    value = float(text)
    return value if math.isfinite(value) else None


def interval(value: float, guarded: bool) -> tuple[float, float]:
    """Bounds of equality with ``value``: relative and absolute tolerance, plus a few units in the last place if guarded."""
    reach = abs(value) * TOLERANCE + TOLERANCE
    low, high = value - reach, value + reach
    slack = max(abs(low), abs(high)) * EPSILON * 4 if guarded else 0.0
    return low - slack, high + slack

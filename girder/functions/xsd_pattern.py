"""XSD patterns as Java regular expressions.

Java lacks only class subtraction, ``[base-[taken]]``, which is an intersection with the complement:
``[base&&[^taken]]``. Everything else passes unchanged, and ``&&`` inside an XSD class is escaped, since there it is
two literal characters.
"""

from __future__ import annotations

from functools import lru_cache

from girder.functions.errors import RuleError


def _class_at(pattern: str, start: int) -> tuple[str, str | None, int] | None:
    """(base, taken class or None, index behind) of the class that opens at ``start``; None if it is not well formed."""
    at = start + 1
    if pattern[at : at + 1] == "^":
        at += 1
    if pattern[at : at + 1] == "]":
        at += 1
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 2
        elif pattern.startswith("-[", at):
            inner = _class_at(pattern, at + 1)
            if inner is None or pattern[inner[2] : inner[2] + 1] != "]":
                return None
            return pattern[start + 1 : at], _java_class(inner[0], inner[1]), inner[2] + 1
        elif sign == "[":
            return None
        elif sign == "]":
            return pattern[start + 1 : at], None, at + 1
        else:
            at += 1
    return None


def _java_class(base: str, taken: str | None) -> str:
    base = base.replace("&&", r"&\&")
    if taken is None:
        return f"[{base}]"
    return f"[[{base}]&&[^{taken}]]"


@lru_cache(maxsize=4096)
def java_pattern(pattern: str) -> str:
    """The pattern with subtractions rewritten."""
    out, at = [], 0
    while at < len(pattern):
        found = _class_at(pattern, at) if pattern[at] == "[" else None
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
        elif found is None:
            out.append(pattern[at])
            at += 1
        else:
            out.append(_java_class(found[0], found[1]))
            at = found[2]
    return "".join(out)


def has_subtraction(pattern: str) -> bool:
    return "&&[^" in java_pattern(pattern) and "-[" in pattern


def full_match(pattern: str) -> str:
    r"""A Java expression that matches a whole value; only ``\n`` ends a line."""
    return rf"(?d)\A(?:{java_pattern(pattern)})\z"


def checked(spark, pattern: str) -> str:
    """``full_match`` of a pattern that Java can compile; RuleError otherwise."""
    made = full_match(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(made)
    except Exception as error:
        raise RuleError(f"pattern {pattern!r} is not a regular expression") from error
    return made

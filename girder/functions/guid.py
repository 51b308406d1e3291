"""Compressed and expanded global ids, in built-in functions.

A compressed id has 22 digits of base 64, 132 bits, of which the last 128 are the id. So with one hex digit of zeros before it and
one behind it an id is 17 bytes whose plain base-64 text starts with the compressed form, but for the digits in use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits of the compressed form.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"
# Fixed value: the digits of base-64 text.
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_COMPRESSED = r"\A[0-9A-Za-z_$]{22}\z"
_EXPANDED = r"\A\{?([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})\}?\z"


def _hyphened(digits: Column) -> Column:
    return F.concat_ws("-", *[F.substring(digits, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def decode(compressed: Column) -> Column:
    """The lower-case hyphenated id, null for anything but 22 digits; of the first digit two bits count."""
    whole = F.hex(F.unbase64(F.concat(F.translate(compressed, DIGITS, _PLAIN), F.lit("AA"))))
    return F.when(compressed.rlike(_COMPRESSED), _hyphened(F.lower(F.substring(whole, 2, 32))))


def _hex_digits(guid: Column) -> Column:
    t = F.trim(guid)
    return F.when(t.rlike(_EXPANDED), F.lower(F.translate(t, "{}-", "")))


def encode(guid: Column) -> Column:
    """The 22 digits of an expanded id (braces and hyphens optional, any case), null for anything else."""
    whole = F.base64(F.unhex(F.concat(F.lit("0"), _hex_digits(guid), F.lit("0"))))
    return F.translate(F.substring(whole, 1, 22), _PLAIN, DIGITS)


def canonical(raw: Column) -> Column:
    """The lower-case hyphenated id of either spelling, null for anything else."""
    t = F.trim(raw)
    digits = _hex_digits(t)
    return F.coalesce(F.when(digits.isNotNull(), _hyphened(digits)), decode(t))


def to_compressed(raw: Column) -> Column:
    return encode(canonical(raw))

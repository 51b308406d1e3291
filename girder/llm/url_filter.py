"""URL filter: rules and a host list tested by Bloom filter cascades, in DataFrame functions only.

A key is ``<host suffix><path prefix>``, such as ``example.com/en/``. A url's candidate keys pair each
suffix of its host's labels with each prefix of its path that has the length of some listed path. A
listed key fits the url exactly if it is one of the candidates, so the longest fitting key is the
longest candidate that is listed.

Membership is decided by a cascade: level 1 is a Bloom filter of the listed keys; level 2 holds the
level's false positives over the complete key universe (all candidate keys of the corpus); level 3 holds
the listed keys that level 2 wrongly matches; and so on until a level has no false positives. Over that
universe the cascade is exact, so no url row is ever joined with a list.

Size: the lists are driver-side sequences, so level 1 has a fixed number of bits per listed key, and its
false positive rate falls with the universe, so that each later level holds about as many keys as are
listed. A level over ``MAX_LEVEL_BITS`` is split by a hash of the key into filters of that size, of which a key asks one.

Defined cases: null url or no ``://`` has empty host and path and the default verdict; an empty path fits
no rule; repeated rows are judged alike; extra columns of the input are ignored; an empty table
gives an empty result; a key in several lists takes the first of allow, block, listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LEVEL_BITS = 1 << 26
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    parts: tuple[tuple[int, ...], ...]  # the words of each part's filter
    bits: int  # of a part
    hashes: int
    seed: int


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """All keys that could fit, longest first; ties keep the longer host first."""
    labels = F.split(host, r"\.")
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    )
    paths = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths), reverse=True)]),
        lambda p: p.isNotNull(),
    )
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    sized = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))
    return F.transform(F.array_sort(sized), lambda s: s["key"])


def bit_positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first, second = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * seed + k)), 8) for k in (0, 1))
    return [(first + F.lit(k) * second) % F.lit(bits).cast("long") for k in range(hashes)]


def part_of(key: Column, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-seed), key), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)


def in_level(key: Column, level: Level) -> Column:
    """Whether the level's filter has the key; the words of a part are one folded array literal."""
    places = bit_positions(key, level.bits, level.hashes, level.seed)

    def test(words: tuple[int, ...]) -> Column:
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        return reduce(and_, [F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in places])

    out = test(level.parts[0])
    part = part_of(key, len(level.parts), level.seed)
    for k, words in enumerate(level.parts[1:], 1):
        out = F.when(part == k, test(words)).otherwise(out)
    return out


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Listed if the first level that lacks the key is an even one (counted from 1), or all odd ones have it."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels), 0, -1):
        out = F.when(in_level(key, levels[k - 1]), out).otherwise(F.lit(k % 2 == 0))
    return out


def _encode(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys``; what reaches the driver is its words."""
    hashes = max(1, round(-math.log2(rate)))
    total = 64 * max(1, math.ceil(count * hashes / math.log(2) / 64))
    parts = -(-total // MAX_LEVEL_BITS)
    bits = 64 * -(-total // (64 * parts))
    place = F.explode(F.array(*bit_positions(F.col("key"), bits, hashes, seed)))
    rows = (
        keys.select(part_of(F.col("key"), parts, seed).alias("part"), place.alias("bit"))
        .groupBy("part", F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("value"))
        .collect()
    )
    words = [[0] * (bits // 64) for _ in range(parts)]
    for part, word, value in rows:
        words[part][word] = value
    return Level(tuple(map(tuple, words)), bits, hashes, seed)


def build_cascade(universe: DataFrame, listed: DataFrame, n_listed: int, n_universe: int, scratch: Scratch, name: str) -> list[Level]:
    """Levels for ``listed`` (column key) that are exact over ``universe`` (column key) and ``listed``.

    An empty list gives no level: nothing is listed.
    """
    if not n_listed:
        return []
    rate = min(0.5, max(2.0**-20, n_listed / max(1, n_universe)))
    levels = [_encode(listed, n_listed, rate, 1)]
    wrong = universe.where(in_level(F.col("key"), levels[0])).select("key", F.lit(0).alias("own"))
    both = wrong.unionByName(listed.select("key", F.lit(1).alias("own"))).groupBy("key").agg(F.max("own").alias("own"))
    both = scratch.save(both, f"{name}-survivors")
    inside, outside = both.where("own = 1"), both.where("own = 0")
    while count := outside.count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(_encode(outside, count, 0.5 if len(levels) > 1 else 0.1, len(levels) + 1))
        inside, outside = outside, inside.where(in_level(F.col("key"), levels[-1]))
    return levels


def keys_frame(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    """One row per key, made in the JVM."""
    if not keys:
        return spark.range(0).select(F.lit("").alias("key"))
    return spark.range(1).select(F.explode(F.split(F.lit("\n".join(keys)), "\n")).alias("key"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    listed_hosts: Sequence[str] = (),
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    rules: (verdict, key) with verdict allow or block and key ``<host><path>``, the path beginning with ``/``.
    The longest fitting rule decides; without one, a listed host or a subdomain of one is blocked, and
    anything else gets ``default``.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    allow = sorted({key for verdict, key in rules if verdict == "allow"})
    block = sorted({key for verdict, key in rules if verdict == "block"} - set(allow))
    hosts = sorted({f"{h.lower()}/" for h in listed_hosts})
    lengths = sorted({len(k) - k.index("/") for k in (*allow, *block)})
    host, path = split_url(F.col(url))

    urls = pages.select(F.col(url).alias("url")).select(*[c.alias(n) for n, c in zip(("host", "path"), split_url(F.col("url")), strict=True)]).distinct()
    rule_keys = urls.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths or [1])).alias("key"))
    host_keys = urls.select(F.explode(candidate_keys(F.col("host"), F.lit("/"), [1])).alias("key"))
    universe = scratch.save(rule_keys.unionByName(host_keys).distinct(), "universe")
    size = universe.count()
    cascade = {
        name: build_cascade(universe, keys_frame(spark, keys), len(keys), size, scratch, name)
        for name, keys in (("allow", allow), ("block", block), ("listed", hosts))
    }
    scratch.drop("universe", *[f"{name}-survivors" for name in cascade])

    def has(name: str, key: Column) -> Column:
        return in_cascade(key, cascade[name]) if cascade[name] else F.lit(False)

    keys = candidate_keys(F.col("host"), F.col("path"), lengths or [1])
    fitting = F.get(F.filter(keys, lambda k: has("allow", k) | has("block", k)), F.lit(0))
    blocked = F.exists(candidate_keys(F.col("host"), F.lit("/"), [1]), lambda k: has("listed", k))
    judged = pages.withColumns({"host": host, "path": path}).withColumn("rule", fitting)
    return judged.withColumn(
        "verdict",
        F.when(F.col("rule").isNotNull(), F.when(has("allow", F.col("rule")), "allow").otherwise("block"))
        .when(blocked, "block")
        .otherwise(default),
    )

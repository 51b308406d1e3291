"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.scratch import Scratch

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round on (u, v) with u > v: every node hands its least neighbour to its larger (or smaller) ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node reachable.

    ``edges`` has the columns a and b; self-edges and repeated edges do no harm. Every round is written, so lost
    executors cost no more than one round.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(pairs, f"{name}-0")
    before = None
    for turn in range(1, MOST_ROUNDS):
        new = scratch.save(_star(_star(now, True), False), f"{name}-{turn}")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{turn - 1}")
        now = new
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
    raise RuntimeError("components did not settle")


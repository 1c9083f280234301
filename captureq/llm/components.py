"""Connected components of an edge table, by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _print(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table, to see whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node that links reach.

    Nodes are of any orderable type. Edges with a null end are ignored; loops give a component of their own; repeated
    edges count once; no edges give no rows. Each round is two shuffles with partial minima, written to the shared
    folder; a node with very many edges is one skewed join key, which adaptive execution splits."""
    kind = edges.schema[a].dataType
    e = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).dropna().distinct()
    now = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _print(now)
    nodes = now
    while before[0]:
        # Large star: every larger neighbour of u hangs on the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the least of them.
        least = _least(large)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        old, now = now, written(small, "stars")
        if old is not nodes:
            discard(old)
        after = _print(now)
        if after == before:
            break
        before = after
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(member, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

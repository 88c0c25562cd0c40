"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars on edges (u, v) with v < u.

    large   every larger neighbour of a node moves to the node's least neighbour
    small   every smaller neighbour and the node itself move there
    """
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the least node reachable.

    Alternating large and small stars, each written to the shared folder, until nothing moves: the
    number of rounds grows with the logarithm of a component's size.  The edges never grow in
    number, and no node's neighbours are gathered in one place.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen, now = None, stage(now, "edges")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, now = mark, stage(_star(_star(now, True), False), "edges")
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least)

"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.session import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: each node hands its smallest neighbour to the larger (or smaller) ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; longs); the root is the smallest node of its component.

    With ``rounds`` only so many are made: then each node has one root of its component, not always the smallest.

    Each round is a fixed number of joins and aggregates, and the rounds grow with the logarithm of the
    longest path.  Every round is written to the shared folder, so that a lost executor repeats one round only.
    """
    spark = edges.sparkSession
    now = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, made = None, 0
    while made != rounds:
        made += 1
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = written(spark, _stars(_stars(now, True), False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of the node and its neighbours.

    The least ones are written first: a join of two plain reads can split a hub's edges over tasks.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")))
    joined = down.join(least, "u")
    out = joined.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.max("a"), F.min("b")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); a component is named by its smallest node.

    Self-loops count for nothing, repeated and reversed edges once; null ends are ignored.
    """
    edges = materialize(edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    before = None
    while True:
        edges = materialize(small_star(materialize(large_star(edges))))
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

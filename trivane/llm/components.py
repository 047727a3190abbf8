"""Connected components by alternating large-star and small-star contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.workspace import discard, materialise


def _starred(edges: DataFrame, both_ways: bool, name: str) -> DataFrame:
    """One contraction of (u, v) with u > v, written; ``edges`` are deleted.

    The minima are written before they are joined, so that both sides of the join are plain shuffles, of which
    Spark can split those of a node with very many neighbours.
    """
    seen = edges.union(edges.select("v", "u")) if both_ways else edges
    least = materialise(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    moved = seen.join(least, "u").select(F.greatest("u", "v").alias("a"), "u", "v", "m")
    if both_ways:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = materialise(out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    discard(least)
    discard(edges)
    return out


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); the component is its smallest node.

    Each round is written to the shared folder, which cuts lineage, and deleted after the next. The rounds end when the edges are stars
    around smallest nodes, which takes about the logarithm of the longest path.
    """
    ends = edges.filter("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    held = materialise(ends.distinct(), "edges")
    before = None
    for _ in range(rounds):
        held = _starred(_starred(held, True, "large"), False, "small")
        now = tuple(held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError("the contraction did not end")

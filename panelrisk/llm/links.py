"""Connected components of a link table, as joins and grouped minima.

Alternates the large-star and small-star rewrites: every node points its
neighbours at the smallest node it sees, until each component is one star.
All state stays in DataFrames; every round is written to the shared checkpoint
folder, so a lost executor costs one round at most. A hub that links to a
third of all nodes is one key of a plain equi-join, which adaptive execution
splits, and of a partially aggregated minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One rewrite; ``edges`` has u > v, and so has the result."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    seen = both.join(least.withColumnRenamed("u", "_k"), F.col("u") == F.col("_k")).select("u", "v", F.least("m", "u").alias("m"))
    if large:
        out = seen.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(seen.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every linked node.

    ``edges``: columns a, b (any comparable type, no nulls; loops and repeats are
    harmless). Returns (node, component) for the nodes of at least one link
    between different nodes; an empty table gives an empty table.
    """
    now = cut_lineage(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        now = cut_lineage(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if (seen.n, seen.x) == mark:
            break
        mark = (seen.n, seen.x)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

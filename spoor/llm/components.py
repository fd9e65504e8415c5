"""Connected components by alternating large-star and small-star steps.

Edges live in DataFrames only. Each step is an aggregate (partial sums before
the shuffle) and an equality join that adaptive execution may split, so a hub
node does not fall to one task. Lineage is cut by a checkpoint every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import materialize

MAX_ROUNDS = 100


def _stars(edges: DataFrame) -> DataFrame:
    """Edges with ``u > v``: connect every larger neighbour of a node, then every smaller one, to the least."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("m"))
    large = (
        both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    large = large.where(F.col("u") != F.col("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    small = large.join(low, F.col("u") == F.col("k"))
    linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(u, v)``; component is the least node reachable.

    Self-loops, repeated and reversed edges are allowed; nulls are dropped; no edges give no rows.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    e = materialize(e)
    before = e.agg(state).head()[0]
    for _ in range(MAX_ROUNDS):
        if before["n"] == 0:
            break
        e = materialize(_stars(e))
        after = e.agg(state).head()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select("v").distinct().join(e.select("u"), F.col("v") == F.col("u"), "left_anti")
    return found.select(F.col("u").alias("node"), "component").union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))

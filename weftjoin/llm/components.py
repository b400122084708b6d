"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equality join.  A hub's edges are partly aggregated before they
are shuffled, and the join back to its edges is one that adaptive execution can split.  Steps are cut
with durable checkpoints; the rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftjoin.llm.support import dealt_anew, durable

_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        both = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(dealt_anew(lowest, "a"), "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(lowest.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (larger, smaller) are stars: every larger end has one edge, and no end is both."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    odd = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 OR (up = 1 AND low = 1)")
    return odd.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that an edge (u, v) has; ``component`` is the smallest id it can reach.

    Self-edges and edges with a null end are ignored, so an id that has only such edges isn't returned;
    without edges there are no rows.
    """
    now = durable(edges.select("u", "v").filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(_ROUNDS):
        if _settled(now):
            break
        now = durable(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
    own = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)

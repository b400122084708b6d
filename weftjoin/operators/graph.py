"""Counts over an edge list (src, dst): 2-paths from degrees, triangles by an ordered join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paths2(edges: DataFrame) -> DataFrame:
    """Directed walks of two edges.  A vertex has in-degree times out-degree of them, so no pairs are made."""
    come = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("a"))
    go = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("b"))
    return come.join(go, "v").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias("n_paths"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles of the undirected graph, each once.

    Edges point from the vertex of smaller degree to that of larger degree, which bounds a vertex's outgoing
    edges by the root of twice the number of edges, so a hub makes no square of its neighbours.
    """
    once = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = once.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("v").alias("a"), F.col("d").alias("da")), degree.select(F.col("v").alias("b"), F.col("d").alias("db"))
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = once.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = e.alias("p").join(e.alias("q"), F.col("p.x") == F.col("q.x")).filter(F.col("p.y") != F.col("q.y"))
    wedge = wedge.select(F.col("p.y").alias("x"), F.col("q.y").alias("y"))
    return wedge.join(e, ["x", "y"]).agg(F.count("*").alias("n_triangles"))

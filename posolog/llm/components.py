"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the vertex's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.least("m", "u").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, are tied to the smallest."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return moved.union(least.select("m", "b")).toDF("a", "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (v, component) for every vertex of edges (a, b): component is the smallest vertex reachable.

    Null ends and loops are left out; repeated edges count once. Each round is written to the shared folder.
    """
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == state:
            break
        state = (n, total)
        now = written(_small_star(_large_star(now)), "edges")
    return now.select(F.col("b").alias("v"), F.col("a").alias("component")).union(now.select("a", "a").distinct())

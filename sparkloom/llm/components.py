"""Connected components by alternating large and small stars, on re-read tables.

Each half round joins every edge with its node's least neighbour; a hot node is split by AQE, and
the number of half rounds is logarithmic in the longest path.  It ends when the edges are stars, which
one aggregation tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Stage


def _are_stars(e: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one at most, and none if a greater one has an edge to it."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x")
    of = e.select(ends).select("x.*").groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return of.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame, stage: Stage, label: str) -> DataFrame:
    """(u, root) for every node with an edge; root is the least node of its component.

    ``edges`` has the columns u and v, of any type with an order; loops and repeats are ignored.
    """
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    e = stage.table(edges.where("u <> v").select(big, small).distinct(), f"{label}-e")
    k = 0
    while not _are_stars(e):
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-l{k}")
        e = stage.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{label}-L{k}")
        least = stage.table(e.groupBy("u").agg(F.min("v").alias("m")), f"{label}-s{k}")
        star = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        e = stage.table(star.distinct(), f"{label}-S{k}")
        old = f"{label}-S{k - 1}" if k > 1 else f"{label}-e"
        stage.drop(f"{label}-l{k}", f"{label}-L{k}", f"{label}-s{k}", old)
    return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())

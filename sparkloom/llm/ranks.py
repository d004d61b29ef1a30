"""Global row numbers without a window over all rows.

Rows are dealt out by ranges of the order and sorted within them; a row's number is its place in its
range plus the sizes of the ranges before it, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Stage, shuffle_width

_LOW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str | Column], stage: Stage, label: str, name: str = "pos") -> DataFrame:
    """``df`` with the number from 0 of each row in ``order``; the rows are written once, sorted.

    Rows that the order does not tell apart are numbered as they come, and share a task: an order that
    may leave many rows equal should end in a column that does not.
    """
    width = shuffle_width(df.sparkSession)
    seq = F.monotonically_increasing_id()
    rows = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("_seq", seq).withColumns({"_range": F.shiftright("_seq", 33), "_seq": F.col("_seq").bitwiseAND(F.lit(_LOW))})
    rows = stage.table(rows, label)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))  # one row for each shuffle partition
    return rows.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_seq")).drop("_range", "_seq", "_before")


def numbered_within(df: DataFrame, key: list[str], order: list[str | Column], stage: Stage, label: str, name: str = "nth") -> DataFrame:
    """``df`` with the number from 1 of each row among those of its key; a key may hold any share of the rows."""
    rows = stage.table(numbered(df, [*key, *order], stage, f"{label}-all", "_pos"), label)
    stage.drop(f"{label}-all")
    first = rows.groupBy(*key).agg(F.min("_pos").alias("_first"))
    return rows.join(first, key).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")

"""Exact de-duplication by deterministic block naming.

The text without blanks is cut into blocks of ``block_bytes`` bytes.  All distinct blocks are sorted, by
their first ``PREFIX`` bytes and then a hash, and a block's name is its place in that order: equal blocks
and only they share an integer, which depends on the blocks alone.  Adjacent integers are then sorted
and named in pairs, round after round, until every document holds one integer; with the number of its
blocks it is an identity that two documents share if and only if their texts are equal.

Rows: null text counts as empty; repeated rows (same id, same text) are rows of one group, of which
one is kept; a null id ranks after every other id.  An empty table gives an empty result.  Only the
id and text columns are read, so further columns cannot clash.

Scale: block bytes are shuffled once, after a map-side distinct; everything else is 32-byte keys and
integers.  Hot keys meet only in partial aggregations and in joins of two re-read tables, which AQE
splits.  The rounds are log2 of the longest document's blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered
from .scratch import Stage
from .textcols import drop_blanks, let, text_or_empty

BLOCK_BYTES = 4096
PREFIX = 16


def _blocks(norm: Column, block_bytes: int) -> Column:
    """The fixed-size byte blocks of a text; an empty text is one empty block."""
    last = lambda b: F.greatest(F.ceil(F.octet_length(b) / F.lit(block_bytes)) - 1, F.lit(0))
    return let(
        norm.cast("binary"),
        lambda b: F.transform(
            F.sequence(F.lit(0).cast("long"), last(b).cast("long")),
            lambda i: F.substring(b, (i * block_bytes + 1).cast("int"), F.lit(block_bytes)),
        ),
    )


def _key(salt: int):
    return lambda block: F.unhex(F.sha2(F.concat(F.lit(str(salt)).cast("binary"), block), 256))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    stage = Stage(spark, "naming")
    norm = drop_blanks(text_or_empty(text_col))
    for salt in range(8):
        name = _key(salt)
        rows = stage.table(
            df.select(
                F.monotonically_increasing_id().alias("rid"),
                F.col(id_col).alias("id"),
                F.length(text_or_empty(text_col)).cast("long").alias("chars"),
                let(norm, lambda t: F.struct(F.sha2(t, 256).alias("sha"), F.transform(_blocks(t, block_bytes), name).alias("keys"))).alias("x"),
            ).select("rid", "id", "chars", "x.sha", "x.keys"),
            f"rows{salt}",
        )
        blocks = df.select(F.explode(_blocks(norm, block_bytes)).alias("block"))
        distinct = blocks.groupBy("block").agg(F.lit(1)).select(F.substring("block", 1, PREFIX).alias("prefix"), name(F.col("block")).alias("key"))
        names = numbered(stage.table(distinct, f"blocks{salt}"), ["prefix", "key"], stage, f"sorted{salt}", "name")
        names = stage.table(names.select("key", "name"), f"names{salt}")
        stage.drop(f"blocks{salt}", f"sorted{salt}")
        if names.groupBy("key").count().where("count > 1").isEmpty():
            break
        # Two different blocks share a key: take keys with another salt, so that no identity collides.
    else:
        raise RuntimeError("no collision-free keys found")
    longest = rows.select(F.max(F.size("keys"))).first()[0] or 1
    level = rows.select("rid", F.size("keys").alias("blocks"), F.posexplode("keys").alias("pos", "key"))
    level = stage.table(level.join(names, "key").select("rid", "blocks", "pos", "name"), "level0")
    done = level.where("blocks = 1").select("rid", "blocks", "name")
    level = level.where("blocks > 1")
    for k in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        half = F.expr("pos div 2").cast("int")
        pairs = stage.table(
            level.groupBy("rid", "blocks", half.alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
            ),
            f"pairs{k}",
        )
        distinct = stage.table(pairs.select("a", "b").distinct(), f"distinct{k}")
        named = stage.table(numbered(distinct, ["a", "b"], stage, f"sorted-pairs{k}", "name"), f"pairnames{k}")
        level = stage.table(pairs.join(named, ["a", "b"]).select("rid", "blocks", "pos", "name"), f"level{k}")
        stage.drop(f"pairs{k}", f"distinct{k}", f"sorted-pairs{k}", f"pairnames{k}")
        ends = F.col("blocks") <= 2**k
        done = done.unionByName(level.where(ends & (F.col("blocks") > 2 ** (k - 1))).select("rid", "blocks", "name"))
        level = level.where(~ends)
    whole = stage.table(
        rows.select("rid", "id", "chars", "sha").join(done, "rid").select("rid", "id", "chars", "sha", "blocks", "name"), "whole"
    )
    best = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    groups = stage.table(whole.groupBy("blocks", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    stage.keep("whole", "groups")
    out = whole.join(groups, ["blocks", "name"])
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

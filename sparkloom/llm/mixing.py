"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 3, 1, 2, repeating.  Together they shall take 150 % of
all words; a source's target stops at twice its own size and the excess is shared again by weight,
round by round, until none is above.

Every document of a source gets ``target / source size`` copies, a whole part and a fraction.  The
fractions are rounded dependently: two documents are paired, and words are moved at random from one
to the other until one holds no copy or a whole one, so the expected copies of each document and the
words of the pair stay.  Blocks of about ``BLOCK`` documents are folded so in parallel, each leaving
one unsettled document; these go into the next, smaller round of blocks, until one per source is
left, which is rounded alone.  A source's words are off its target by less than that document.

Rows: null text and empty text have size 0, are taken once per whole copy and add no words; a null
source is a source; repeated rows are documents of their own, as are rows with a null id.  Randomness
is a hash of the id, the source, the text and the seed, and of equal rows, which are numbered, of the
number: reruns agree, whatever order or layout the rows come in (equal rows may change places), and a
repeated id fills many blocks.  An empty table gives an empty result.  Only id, text and source are read.

Scale: texts are read once, for their size; rounds shuffle fixed-width rows, each round a
``BLOCK``-th of the one before, grouped by (source, block) so that a hot source has many groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, numbered_within
from .scratch import Stage
from .textcols import WORD, let, text_or_empty, unit

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK = 64
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, stage: Stage, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target); sources may be any number, no task holds them all."""
    src = stage.table(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    src = stage.table(numbered(src, [F.col("source").asc_nulls_last()], stage, "placed", "place").withColumn("w", weight).drop("place"), "weighed")
    cap = F.col("source_size") * most
    level, above, total = None, -1, (src.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        # Those above stay at their caps; the level rises for the others, so that none comes back below.
        full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("w")
        n, held, w = src.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == above or not w:
            break
        above, level = n, max(0.0, (total - held) / w)
    return src.select("source", "source_size", "n", F.least(cap, F.lit(float(level or 0)) * F.col("w")).alias("target"))


def _pivot(seed: int):
    """One step of the fold: pair the unsettled document with the next, settle one of them."""

    def settle(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["id"].alias("id"), x["size"].alias("size"), x["whole"].alias("whole"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        ma, mb = a["p"] * a["size"], x["p"] * x["size"]
        up = F.least(a["size"] - ma, mb)  # words that a can gain
        down = F.least(ma, x["size"] - mb)  # words that a can lose
        gain = unit(F.lit(seed), a["h"], x["h"]) * (up + down) < down
        moved = F.when(gain, up).otherwise(-down)
        pa = (ma + moved) / a["size"]
        pb = (mb - moved) / x["size"]
        snap = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        ends = snap(pa).isin(0.0, 1.0)
        both = F.struct(
            F.when(ends, settle(x, snap(pb))).otherwise(settle(a, snap(pa))).alias("left"),
            F.when(ends, settle(a, snap(pa))).otherwise(settle(x, snap(pb))).alias("done"),
        )
        return both

    def fold(acc: Column, x: Column) -> Column:
        nxt = F.when(
            acc["left"]["p"].isin(0.0, 1.0), F.struct(x.alias("left"), acc["left"].alias("done"))
        ).otherwise(step(acc, x))
        return let(nxt, lambda y: F.struct(y["left"].alias("left"), F.concat(acc["done"], F.array(y["done"])).alias("done")))

    return fold


def _row_hashes(sized: DataFrame, seed: int, stage: Stage) -> DataFrame:
    """``sized`` with h, which differs between rows: equal rows are numbered."""
    key = F.xxhash64(F.lit(seed), F.col("doc").isNull(), "doc", F.col("source").isNull(), "source", "text_hash")
    sized = sized.select("*", key.alias("key")).drop("text_hash")
    twins = stage.table(sized.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "twins")
    if twins.isEmpty():
        return sized.withColumnRenamed("key", "h")
    nth = numbered_within(sized.join(twins, "key", "left_semi").select("key", "rid"), ["key"], ["rid"], stage, "twin")
    nth = stage.table(nth.select("rid", F.xxhash64("key", "nth").alias("own")), "own")
    return sized.join(nth, "rid", "left").withColumn("h", F.coalesce("own", "key")).drop("own", "key")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, row: str | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    ``rid`` is returned as well, for joining rows back: the column ``row``, a long that differs between
    rows, or the row's number in this run.
    """
    stage = Stage(df.sparkSession, "mix")
    text = text_or_empty(text_col)
    rid = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    sized = stage.table(
        df.select(rid.alias("rid"), F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash")),
        "sizes",
    )
    targets = stage.table(source_targets(sized, stage), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Sources are few beside documents, but nothing bounds them: Spark broadcasts by measured size only.
    t = targets.withColumnRenamed("source", "s")
    rows = _row_hashes(sized, seed, stage)
    rows = rows.join(t, rows["source"].eqNullSafe(t["s"])).drop("s").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + EPS)
    frac = F.when(F.col("rate") - whole < EPS, 0.0).otherwise(F.col("rate") - whole)
    rows = stage.table(rows.withColumns({"whole": whole.cast("int"), "p": frac}).drop("rate"), "rows")
    item = F.struct((-F.col("size")).alias("o"), F.col("h"), F.struct("rid", "doc").alias("id"), F.col("size").cast("double").alias("size"), "whole", "p")
    open_rows = (F.col("size") > 0) & (F.col("p") > 0)
    item_type = f"struct<h:bigint,id:struct<rid:bigint,doc:{df.schema[id_col].dataType.simpleString()}>,size:double,whole:int,p:double>"
    cols = ["source", "source_size", "target"]
    level = rows.where(open_rows).select(*cols, "n", item.alias("x"))
    most = targets.agg(F.max("n")).first()[0] or 1
    stage.keep("rows")
    settled = []
    k = 0
    while True:
        blocks = F.ceil(F.col("n") / F.lit(float(BLOCK ** (k + 1)))).cast("long")
        folded = F.aggregate(
            F.slice(F.col("xs"), F.lit(2), F.size("xs")),
            F.struct(_strip(F.col("xs")[0]).alias("left"), F.array().cast(f"array<{item_type}>").alias("done")),
            lambda acc, y: _pivot(seed + k)(acc, _strip(y)),
        )
        grouped = level.groupBy(*cols, "n", F.pmod(F.xxhash64(F.lit(seed + 100 + k), F.col("x.h")), blocks).alias("block")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
        out = stage.table(grouped.select(*cols, "n", folded.alias("f")), f"level{k}")
        settled.append(out.select(*cols, F.explode("f.done").alias("x")))
        level = out.select(*cols, "n", F.struct((-F.col("f.left.size").cast("long")).alias("o"), "f.left.h", "f.left.id", "f.left.size", "f.left.whole", "f.left.p").alias("x"))
        if BLOCK ** (k + 1) >= most:
            break
        k += 1
    last = F.when(unit(F.lit(seed + 1000), F.col("x.h")) < F.col("x.p"), 1).otherwise(0)
    parts = [d.select(*cols, "x.id", "x.size", (F.col("x.whole") + F.col("x.p").cast("int")).alias("copies")) for d in settled]
    parts.append(level.select(*cols, "x.id", "x.size", (F.col("x.whole") + last).alias("copies")))
    parts.append(rows.where(~open_rows).select(*cols, F.struct("rid", "doc").alias("id"), F.col("size").cast("double").alias("size"), F.col("whole").alias("copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    size = F.col("size").cast("long")
    return out.select(
        F.col("id.doc").alias(id_col), "source", size.alias("size"), "source_size", "target",
        F.col("copies").cast("long").alias("copies"), (size * F.col("copies")).alias("taken"), F.col("id.rid").alias("rid"),
    )


def _strip(x: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["id"].alias("id"), x["size"].alias("size"), x["whole"].alias("whole"), x["p"].alias("p"))

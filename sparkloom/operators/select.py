"""De-duplication, ranking, balanced picks and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key; a window, as ``dropDuplicates`` picks any row."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def first_n(df: DataFrame, n: int, group: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def greedy_two_key(df: DataFrame, order: str, title: str, host: str, chars: str, group: str | None = None, candidates: int = 12, least: int = 80, most: int = 4, prefix: int = 12) -> DataFrame:
    """Accept in order unless the title's prefix or the host is already accepted.

    The order decides, so the first ``candidates`` rows (the operator's own limit) of a group, or of all,
    are one fold.
    """
    item = F.struct(F.col(order).cast("long").alias("ord"), F.substring(title, 1, prefix).alias("t"), F.col(host).alias("d"), F.col(chars).cast("int").alias("n"))
    kind = "array<struct<ord:bigint,t:string,d:string,n:int>>"
    if group is None:
        rows = df.orderBy(order).limit(candidates).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    else:
        rows = first_n(df, candidates, [group], F.col(order)).groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.exists(acc, lambda a: (a["t"] == x["t"]) | (a["d"] == x["d"]))
        return F.when((F.size(acc) >= most) | seen | (x["n"] < least), acc).otherwise(F.concat(acc, F.array(x)))

    keys = [group] if group else []
    return rows.select(*keys, F.explode(F.aggregate(F.col("xs").cast(kind), F.array().cast(kind), step)).alias("x")).select(*keys, "x.*")


def balanced(df: DataFrame, source: str, order: str, score: Column, most: int) -> DataFrame:
    """Round-robin over the sources by first appearance, best score first within each."""
    rk = F.row_number().over(W.partitionBy(source).orderBy(score.desc(), F.col(order)))
    top = df.withColumn("rk", rk).where(F.col("rk") <= most)
    firsts = df.groupBy(F.col(source).alias("_s")).agg(F.min(order).alias("so"))
    return top.join(firsts, F.col(source).eqNullSafe(F.col("_s"))).drop("_s").orderBy("rk", "so").limit(most)


def relaxed_pool(df: DataFrame, chars: str, strict: int = 80, loose: int = 20, enough: int = 6) -> DataFrame:
    n = df.agg(F.count_if(F.col(chars) >= strict).alias("_strict"))
    return df.join(F.broadcast(n)).where(F.col(chars) >= F.when(F.col("_strict") >= enough, strict).otherwise(loose)).drop("_strict")


def lanes(guaranteed: DataFrame, rest: DataFrame, order: list[str], most: int = 12, slots: int = 4) -> DataFrame:
    """The guaranteed rows first, then the rest up to ``most``."""
    a = guaranteed.orderBy(*order).limit(slots).withColumn("lane", F.lit(0))
    return a.unionByName(rest.withColumn("lane", F.lit(1))).orderBy("lane", *order).limit(most)


def best_voice(df: DataFrame, score: Column, order: str) -> DataFrame:
    """The best voice, of equal ones the first; none where no voice scores 0 or more."""
    return df.withColumn("score", score).where("score >= 0").orderBy(F.desc("score"), order).limit(1)


def tiered(formal: Column, tier1: Column, tier2: Column, rules: Column) -> Column:
    """struct<text, method>: the first tier that answered; a tier-2 echo of its input takes the rules."""
    second = F.when(tier2 == formal, rules).otherwise(tier2)
    return F.struct(F.coalesce(tier1, second, rules).alias("text"), F.when(tier1.isNotNull(), "tier1").when(tier2.isNotNull(), "tier2").otherwise("rules").alias("method"))


def set_method(df: DataFrame) -> DataFrame:
    """The method of a whole set: verified if any article is, by a model if any is, else by rules."""
    verified, model = F.bool_or("verified"), F.bool_or(F.col("method") != "rules")
    return df.agg(F.when(verified, "llm+verify").when(model, "llm").otherwise("rules").alias("method"), F.count(F.lit(1)).alias("articles"), F.sum("repaired").alias("repaired"))

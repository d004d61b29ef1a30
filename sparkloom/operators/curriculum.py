"""Curriculum rows: source scenarios to the shape that is written and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality

# What a scenario has where its source has none.
EMOJI, LEVEL = "💬", 1
_TITLE = "struct<en:string,hant:string,hans:string>"
SOURCE = f"categories array<struct<id:string,emoji:string,title:{_TITLE},scenarios:array<struct<id:string,emoji:string,level:int,title:{_TITLE},lines:array<struct<speaker:string,formal:string,colloquial:string,en:string>>>>>>"


def _or(c: Column, other) -> Column:
    """``other`` where the value is null, empty or 0."""
    return F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0"), F.lit(other)).otherwise(c)


def build(source: DataFrame, table: Column) -> DataFrame:
    """One row (version, categories) of a source's row; ``table`` maps a character to its readings."""

    def line(x: Column, i: Column) -> Column:
        jyutping = F.when(x["colloquial"].isNotNull(), quality.readings(x["colloquial"], table))
        return F.struct(i.alias("id"), i.alias("paragraph_id"), x["speaker"].alias("speaker"), x["formal"].alias("formal"), x["colloquial"].alias("colloquial"), jyutping.alias("jyutping"), F.coalesce(x["en"], F.lit("")).alias("en"))

    def scenario(x: Column) -> Column:
        return F.struct(x["id"].alias("id"), _or(x["emoji"], EMOJI).alias("emoji"), _or(x["level"], LEVEL).alias("level"), x["title"].alias("title"), F.transform(F.coalesce(x["lines"], F.array()), line).alias("sentences"))

    def category(x: Column) -> Column:
        return F.struct(x["id"].alias("id"), _or(x["emoji"], EMOJI).alias("emoji"), x["title"].alias("title"), F.transform(F.coalesce(x["scenarios"], F.array()), scenario).alias("scenarios"))

    return source.select(F.lit(2).alias("version"), F.transform("categories", category).alias("categories"))


def source_failures(source: DataFrame) -> DataFrame:
    """(place, rule) of everything that keeps a source from being written."""
    cats = source.select(F.explode("categories").alias("c")).select("c.*").withColumn("place", F.coalesce("id", F.lit("?")))
    of_cat = quality.failures(cats, "place", {"category id and titles": quality.titled(F.col("id"), F.col("title")), "scenarios": F.size("scenarios") >= quality.LEAST_SCENARIOS})
    scen = cats.select("place", F.explode("scenarios").alias("s")).select(F.concat_ws("/", "place", F.coalesce("s.id", F.lit("?"))).alias("place"), "s.*")
    given = (F.coalesce("id", F.lit("")) != "") & F.col("title").isNotNull() & (F.size("lines") > 0)
    lines = scen.select("place", F.posexplode("lines").alias("i", "x")).select(F.concat("place", F.lit("#"), F.col("i").cast("string")).alias("place"), "x.*")
    of_line = quality.failures(lines, "place", quality.curriculum_rules(F.col("formal"), F.col("colloquial")))
    return of_cat.unionByName(quality.failures(scen, "place", {"scenario id, title and lines": given})).unionByName(of_line)


def as_articles(curriculum: DataFrame, lang: str, section: str) -> DataFrame:
    """Scenarios in the shape of articles, titled in a language or else in English or else by id."""
    rows = curriculum.select(F.explode("categories").alias("c")).select(F.col("c.title").alias("of"), F.explode("c.scenarios").alias("s"))
    of = F.coalesce(F.col("of")[lang], F.col("of")["en"])
    title = F.coalesce(F.col("s.title")[lang], F.col("s.title")["en"], F.col("s.id"))
    source = F.when(F.coalesce(of, F.lit("")) != "", F.concat(F.lit(f"{section} · "), of)).otherwise(section)
    return rows.select(F.col("s.id").alias("id"), F.lit(True).alias("conversation"), title.alias("title"), source.alias("source"), F.lit("").alias("url"), F.lit(True).alias("converted"), F.col("s.sentences").alias("sentences"))

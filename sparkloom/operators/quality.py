"""Declarative data-quality checks: rows of failed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import CJK

# Characters of the spoken layer that may not stand in the written one.
SPOKEN_ONLY = "嘅咗唔哋喺畀嚟搵嘢冇啲㗎蚊"
LEAST_SCENARIOS = 12


def failures(df: DataFrame, key: str | list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row fails; a null result is a failure."""
    keys = [key] if isinstance(key, str) else key
    failed = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(name) for name, ok in rules.items()])
    return df.select(*keys, F.explode(F.array_compact(failed)).alias("rule"))


def failure_counts(failed: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(rule, failures); with ``rules`` also those that none fails."""
    counts = failed.groupBy("rule").agg(F.count(F.lit(1)).alias("failures"))
    if rules is None:
        return counts
    every = failed.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(counts, "rule", "left").select("rule", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


def _given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def titled(id: Column, title: Column) -> Column:
    """An id and a title in all three languages."""
    return _given(id) & _given(title["en"]) & _given(title["hant"]) & _given(title["hans"])


def lesson_failures(lessons: DataFrame, name: str) -> DataFrame:
    """(place, rule) of a lesson set's articles and sentences; a set without articles is one failure.

    ``lessons`` has one row, with ``articles``; no row means that the file is missing.
    """
    articles = lessons.select(F.explode("articles").alias("a")).select("a.*")
    found = lessons.agg(F.coalesce(F.max(F.size("articles")), F.lit(-1)).alias("n"))
    none = found.select(F.lit(name).alias("place"), F.when(F.col("n") < 0, "missing").when(F.col("n") == 0, "no articles").alias("rule")).where("rule IS NOT NULL")
    place = F.concat(F.lit(f"{name} "), F.coalesce("id", F.lit("?")))
    rules = {"id and title": _given(F.col("id")) & _given(F.col("title")), "sentences": F.size("sentences") > 0}
    rows = articles.select(place.alias("place"), F.explode("sentences").alias("s")).select(F.concat("place", F.lit("#"), F.col("s.id").cast("string")).alias("place"), "s.*")
    own = sentence_rules(F.col("formal"), F.col("colloquial"), F.col("jyutping"), F.col("pairs"))
    return none.unionByName(failures(articles.withColumn("place", place), "place", rules)).unionByName(failures(rows, "place", own))


def conversation_failures(curriculum: DataFrame) -> DataFrame:
    """(place, rule) of a curriculum's categories, scenarios and lines; only full categories are looked into."""
    cats = curriculum.select(F.explode("categories").alias("c")).select("c.*").withColumn("place", F.coalesce("id", F.lit("?")))
    enough = F.size("scenarios") >= LEAST_SCENARIOS
    found = curriculum.agg(F.coalesce(F.max(F.size("categories")), F.lit(-1)).alias("n"))
    none = found.select(F.lit("conversations").alias("place"), F.when(F.col("n") < 0, "missing").when(F.col("n") == 0, "no categories").alias("rule")).where("rule IS NOT NULL")
    of_cat = failures(cats, "place", {"category id and titles": titled(F.col("id"), F.col("title")), "scenarios": enough})
    scen = cats.where(enough).select("place", F.explode("scenarios").alias("s")).select(F.concat_ws("/", "place", F.coalesce("s.id", F.lit("?"))).alias("place"), "s.*")
    of_scen = failures(scen, "place", {"scenario id and titles": titled(F.col("id"), F.col("title")), "lines": F.size("sentences") > 0})
    rows = scen.select("place", F.explode("sentences").alias("s")).select(F.concat("place", F.lit("#"), F.col("s.id").cast("string")).alias("place"), "s.*")
    own = sentence_rules(F.col("formal"), F.col("colloquial"), F.col("jyutping"), F.lit(None).cast("array<struct<f:string,c:string>>")) | {"speaker": _given(F.col("speaker").cast("string"))}
    return none.unionByName(of_cat).unionByName(of_scen).unionByName(failures(rows, "place", own))


def sentence_rules(formal: Column, colloquial: Column, jyutping: Column, pairs: Column) -> dict[str, Column]:
    chars = F.filter(F.split(colloquial, ""), lambda x: x != "")
    syllables = F.forall(F.zip_with(chars, jyutping, lambda a, b: F.rlike(a, F.lit(f"[{CJK}]")) == (b != "")), lambda ok: ok)
    joined = (F.array_join(F.transform(pairs, lambda p: p["f"]), "") == formal) & (F.array_join(F.transform(pairs, lambda p: p["c"]), "") == colloquial)
    return {
        "formal": F.coalesce(formal, F.lit("")) != "",
        "colloquial": F.coalesce(colloquial, F.lit("")) != "",
        "jyutping-length": F.size(jyutping) == F.length(colloquial),
        "jyutping-syllables": F.when(F.size(jyutping) == F.length(colloquial), syllables).otherwise(False),
        "pairs": pairs.isNull() | ((F.size(pairs) > 0) & joined),
    }


def curriculum_rules(formal: Column, colloquial: Column, spoken: str = SPOKEN_ONLY) -> dict[str, Column]:
    return {
        "formal": F.coalesce(formal, F.lit("")) != "",
        "colloquial": F.coalesce(colloquial, F.lit("")) != "",
        "written-layer": ~F.rlike(F.coalesce(formal, F.lit("")), F.lit(f"[{spoken}]")),
        "digits": ~F.rlike(F.concat_ws("", formal, colloquial), F.lit("[0-9]")),
    }


def readings(text: Column, table: Column) -> Column:
    """One syllable or an empty string per code point, from a dictionary column."""
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda ch: F.coalesce(F.get(F.try_element_at(table, ch), F.lit(0)), F.lit("")))


def distinct_readings(readings: DataFrame) -> DataFrame:
    """(ch, readings) of landed (ch, ord, syllable): toneless, each once in order, for the plane's two main blocks."""
    code = F.ascii("ch")
    wanted = readings.where((F.length("ch") == 1) & (code.between(0x3400, 0x4DBF) | code.between(0x4E00, 0x9FFF)))
    rows = wanted.select("ch", F.struct("ord", F.regexp_replace("syllable", r"[0-9]+\z", "").alias("s")).alias("x")).where("x.s <> ''")
    kept = F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]))
    return rows.groupBy("ch").agg(kept.alias("readings"))

"""Lesson building as one lazy plan: bodies to units, units through the tiers, sentences to articles and a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.chars import HAN, ScriptProfile, script_count
from ..functions.clean import strip_junk
from ..functions.numerals import spell_out, spell_out_pairs
from ..functions.rules import STARTER, is_changed, segments
from ..functions.segment import pack, paragraphs_or_whole
from ..operators import quality, select
from ..operators.align import align_pairs

# What a set says of how it was made.
NOTES = {
    "llm+verify": "Rewritten to spoken Cantonese by a model and cross-checked by an independent reviewer.",
    "llm": "Rewritten to spoken Cantonese by an AI model with a second review pass, from live news.",
    "rules": "Auto-converted to Cantonese (rule-based, rough) from live RSS news.",
}


def units(bodies: DataFrame, key: str, body: str, p: ScriptProfile = HAN) -> DataFrame:
    """(key, paragraph_id, unit_id, formal, chars); the whole body stands in for no paragraphs."""
    rows = bodies.select(key, F.posexplode(paragraphs_or_whole(F.col(body), p)).alias("paragraph_id", "x"))
    rows = rows.select(key, "paragraph_id", F.posexplode(pack(F.col("x"), p)).alias("unit_id", "u"))
    return rows.select(key, "paragraph_id", "unit_id", F.col("u.text").alias("formal"), F.col("u.chars").alias("chars"))


def article_units(articles: DataFrame, p: ScriptProfile = HAN) -> DataFrame:
    """(article_id, unit_id, paragraph_id, formal) of (article_id, body); unit_id counts through the article."""
    own = F.transform(paragraphs_or_whole(F.col("body"), p), lambda x, i: F.transform(pack(x, p), lambda u: F.struct(i.alias("paragraph_id"), u["text"].alias("formal"))))
    return articles.select("article_id", F.posexplode(F.flatten(own)).alias("unit_id", "u")).select("article_id", "unit_id", "u.*")


def lesson_sentences(rows: DataFrame, rules: dict[str, str] = STARTER) -> DataFrame:
    """Units with their rewritten and spelled-out text; pairs only where there is more than one."""
    rows = rows.withColumn("pairs", spell_out_pairs(segments(F.col("formal"), rules)))
    rows = rows.withColumn("colloquial", F.array_join(F.transform("pairs", lambda p: p["c"]), ""))
    return rows.withColumn("pairs", F.when(F.size("pairs") > 1, F.col("pairs")))


def choose(primary: DataFrame, secondary: DataFrame, score: Column, cfg: EngineConfig = EngineConfig(), p: ScriptProfile = HAN) -> DataFrame:
    """The day's articles: boilerplate dropped, secondary ones first, then a balanced pick of the others.

    Both have (title, body, url, published, source, ord); the result has article_id in the order chosen.
    """
    cleaned = lambda df: df.withColumn("body", strip_junk(F.coalesce("body", F.lit("")))).withColumn("_n", script_count(F.col("body"), p))
    first = cleaned(secondary).where(F.col("_n") >= cfg.secondary_chars).orderBy("ord").limit(cfg.most_secondary)
    pool = select.relaxed_pool(cleaned(primary), "_n", cfg.preferred_chars, cfg.relaxed_chars, cfg.enough)
    picked = select.balanced(pool, "source", "ord", score, cfg.most_articles).drop("so")
    both = first.withColumns({"lane": F.lit(0), "rk": F.lit(0), "so": F.lit(0).cast("long")}).unionByName(picked.join(pool.groupBy("source").agg(F.min("ord").cast("long").alias("so")), "source").withColumn("lane", F.lit(1)))
    both = both.orderBy("lane", "rk", "so", "ord").limit(cfg.most_articles)
    place = F.struct("lane", "rk", "so", "ord")
    ranked = both.agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "title", "body", "url", "published", "source"))).alias("xs"))
    rows = ranked.select(F.posexplode("xs").alias("i", "x"))  # at most the day's number of articles
    return rows.select(F.concat(F.lit("a"), F.col("i").cast("string")).alias("article_id"), "x.title", "x.body", "x.url", "x.published", "x.source")


def sentences(rows: DataFrame, tier1: DataFrame, tier2: DataFrame, readings: Column, rules: dict[str, str] = STARTER) -> DataFrame:
    """(article_id, unit_id, paragraph_id, formal, colloquial, jyutping, pairs, method, verified, repaired).

    An article takes tier 1 (article_id, unit_id, colloquial, pairs, verified, repaired) if it is there, else
    tier 2 (article_id, unit_id, colloquial), else rules.  Tier 1 without pairs and tier 2 are aligned; what tier 2
    left as it was takes rules.
    """
    one = tier1.select("article_id", "unit_id", F.col("colloquial").alias("_c1"), F.col("pairs").alias("_p1"), F.col("verified").alias("_v"), F.col("repaired").alias("_r"))
    two = tier2.select("article_id", "unit_id", F.col("colloquial").alias("_c2"))
    rows = rows.join(one, ["article_id", "unit_id"], "left").join(two, ["article_id", "unit_id"], "left")
    by_rules = F.col("_c1").isNull() & (F.col("_c2").isNull() | (F.col("_c2") == F.col("formal")))
    rows = rows.withColumn("_said", F.coalesce("_c1", "_c2")).withColumn("_aligned", align_pairs("formal", "_said"))
    rows = rows.withColumn("_pairs", F.when(by_rules, segments(F.col("formal"), rules)).otherwise(F.coalesce("_p1", "_aligned")))
    rows = rows.withColumn("_spelled", spell_out_pairs(F.col("_pairs")))
    said = F.when(F.col("_spelled").isNotNull(), F.array_join(F.transform("_spelled", lambda p: p["c"]), "")).otherwise(spell_out(F.col("_said")))
    rows = rows.withColumn("colloquial", said)
    method = F.when(F.col("_c1").isNotNull(), F.when(F.col("_v"), "llm+verify").otherwise("llm")).when(F.col("_c2").isNotNull(), "llm").otherwise("rules")
    return rows.select(
        "article_id", "unit_id", "paragraph_id", "formal", "colloquial", quality.readings(F.col("colloquial"), readings).alias("jyutping"),
        F.when(F.size("_spelled") > 1, F.col("_spelled")).alias("pairs"), method.alias("method"), F.coalesce("_v", F.lit(False)).alias("verified"), F.coalesce("_r", F.lit(False)).alias("repaired"),
    )


def build(articles: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, title, source, url, publishedAt, converted, method, verified, repaired, sentences): articles as they are written.

    articles: (article_id, title, source, url, published); an article has as many rows as its own sentences.
    """
    s = F.struct(F.col("unit_id").alias("id"), "paragraph_id", "formal", "colloquial", "jyutping", "pairs")
    verified = F.bool_or("verified")
    of = rows.groupBy("article_id").agg(
        F.bool_or(is_changed(F.col("formal"), F.col("colloquial"))).alias("converted"), F.max("method").alias("method"), F.when(verified, True).alias("verified"),
        F.when(verified, F.count_if("repaired").cast("int")).alias("repaired"), F.array_sort(F.collect_list(s), lambda a, b: a["id"] - b["id"]).alias("sentences"),
    )
    rows = articles.join(of, "article_id", "left")
    empty = F.array().cast(rows.schema["sentences"].dataType)
    return rows.select(
        F.col("article_id").alias("id"), "title", "source", "url", F.col("published").alias("publishedAt"), F.coalesce("converted", F.lit(False)).alias("converted"),
        F.coalesce("method", F.lit("rules")).alias("method"), "verified", "repaired", F.coalesce("sentences", empty).alias("sentences"),
    )


def lesson_set(built: DataFrame, cfg: EngineConfig = EngineConfig(), secondary: str = "") -> DataFrame:
    """One row (date, source, method, note, generatedAt, articles); none where there is no article."""
    a = F.struct(*built.columns)
    order = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    rows = built.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), a.alias("a")))).alias("xs"), F.bool_or("verified").alias("v"), F.bool_or(F.col("method") != "rules").alias("m"))
    method = F.when(F.col("v"), "llm+verify").when(F.col("m"), "llm").otherwise("rules")
    note = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    source = F.lit(f"{cfg.source} + {secondary}" if secondary else cfg.source)
    rows = rows.where(F.size("xs") > 0).withColumn("method", method)
    return rows.select(F.lit(cfg.date).alias("date"), source.alias("source"), "method", F.element_at(note, F.col("method")).alias("note"), F.lit(cfg.generated_at).alias("generatedAt"), F.transform("xs", lambda x: x["a"]).alias("articles"))


def paragraph_groups(rows: DataFrame) -> DataFrame:
    """(article_id, paragraph_id, lines) in reading order: sentences by paragraph, those without one in paragraph 0."""
    return rows.groupBy("article_id", F.coalesce("paragraph_id", F.lit(0)).alias("paragraph_id")).agg(F.array_sort(F.collect_list(F.struct("unit_id", "formal", "colloquial"))).alias("lines"))


def unavailable(built: DataFrame, set_method: Column) -> Column:
    """Whether an article is shown as not converted: a model's tier left it as it was."""
    return (F.col("converted") == F.lit(False)) & (F.col("method") != "rules") & (set_method != "rules")


def nest(rows: DataFrame, key: str) -> DataFrame:
    """One row per article with its sentences in order: the shape that is written."""
    s = F.struct("paragraph_id", "unit_id", "formal", "colloquial", "pairs")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("sentences"), F.bool_or(F.col("formal") != F.col("colloquial")).alias("converted"))

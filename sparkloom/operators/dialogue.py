"""Dialogue voices, content-addressed names and curriculum rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The voices, in order of first appearance.
VOICES = ["zh-HK-HiuMaanNeural", "zh-HK-WanLungNeural", "zh-HK-HiuGaaiNeural"]
NEWS_VOICE = VOICES[0]
# The names of the levels by language.
LEVELS = {"en": ["Beginner", "Intermediate", "Advanced"], "hant": ["入門", "進階", "高級"], "hans": ["入门", "进阶", "高级"]}


def audio_name(text: Column, voice: Column) -> Column:
    return F.concat(F.substring(F.sha1(F.concat_ws("|", text, voice).cast("binary")), 1, 16), F.lit(".mp3"))


def assign_voices(lines: DataFrame, scenario: str, order: str, speaker: str, text: str) -> DataFrame:
    """Lines with text get their speaker's voice: the k-th new speaker of a scenario has voice k mod 3.

    First appearances are aggregated per (scenario, speaker), so only speakers are ranked.
    """
    rows = lines.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_who", F.coalesce(F.nullif(F.col(speaker), F.lit("")), F.lit("?")))
    firsts = rows.groupBy(scenario, "_who").agg(F.min(order).alias("_fi"))
    firsts = firsts.withColumn("_k", F.dense_rank().over(W.partitionBy(scenario).orderBy("_fi")) - 1).drop("_fi")
    voice = F.get(F.array(*[F.lit(v) for v in VOICES]), F.col("_k") % len(VOICES))
    return rows.join(firsts, [scenario, "_who"]).withColumn("voice", voice).drop("_who", "_k")


def localized(title: Column, lang: str) -> Column:
    return F.coalesce(title[lang], title["en"])


def speaker_name(speaker: Column, lang: str) -> Column:
    return F.coalesce(speaker["raw"], speaker[lang], speaker["hant"], speaker["en"])


def news_text(colloquial: Column, formal: Column) -> Column:
    """What is read aloud of a news sentence; null where there is nothing."""
    return F.coalesce(F.nullif(colloquial, F.lit("")), F.nullif(formal, F.lit("")))


def news_lines(lessons: DataFrame) -> DataFrame:
    """(article_id, sentence_id, text, voice, audio) of a lesson set's sentences that have a text."""
    rows = lessons.select(F.explode("articles").alias("a")).select(F.col("a.id").alias("article_id"), F.explode("a.sentences").alias("s"))
    rows = rows.select("article_id", F.col("s.id").alias("sentence_id"), news_text(F.col("s.colloquial"), F.col("s.formal")).alias("text")).where("text IS NOT NULL")
    return rows.withColumn("voice", F.lit(NEWS_VOICE)).withColumn("audio", audio_name(F.col("text"), F.col("voice")))


def dialogue_lines(curriculum: DataFrame) -> DataFrame:
    """The same of a curriculum, whose lines are read by their speakers' voices."""
    rows = curriculum.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("cat"), F.explode("c.scenarios").alias("s"))
    rows = rows.select(F.concat_ws("/", "cat", "s.id").alias("article_id"), F.explode("s.sentences").alias("x")).select("article_id", F.col("x.id").alias("sentence_id"), F.col("x.speaker").cast("string").alias("who"), F.col("x.colloquial").alias("text"))
    rows = assign_voices(rows, "article_id", "sentence_id", "who", "text").drop("who")
    return rows.withColumn("audio", audio_name(F.col("text"), F.col("voice")))


def label(df: DataFrame, key: Column, labels: DataFrame, lang: str, name: str = "label") -> DataFrame:
    """``df`` with the key's text: in the language, else in English, else the key itself.

    ``labels`` has (key, lang, text) and is joined by Spark's own choice.
    """
    by = labels.where(F.col("lang").isin(lang, "en")).groupBy(F.col("key").alias("_key")).agg(
        F.max(F.when(F.col("lang") == lang, F.col("text"))).alias("_own"), F.max(F.when(F.col("lang") == "en", F.col("text"))).alias("_en")
    )
    return df.withColumn("_k", key).join(by, F.col("_k") == F.col("_key"), "left").withColumn(name, F.coalesce("_own", "_en", "_k")).drop("_k", "_key", "_own", "_en")


def filled(text: Column, *values: Column) -> Column:
    """A label's text with its places {0}, {1} and so on filled."""
    for i, v in enumerate(values):
        text = F.replace(text, F.lit(f"{{{i}}}"), v.cast("string"))
    return text


def level_name(level: Column, lang: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LEVELS[lang]]), level - 1), F.lit(""))


def voice_score(lang: Column, name: Column) -> Column:
    """How well a voice suits; negative for a voice of another language."""
    lang = F.replace(F.lower(F.coalesce(lang, F.lit(""))), F.lit("_"), F.lit("-"))
    name = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(F.contains(name, F.lit("sinji")), 6)
        .when((lang == "zh-hk") | F.startswith(lang, F.lit("yue")), 5)
        .when(F.rlike(name, F.lit("cantonese|粵|aasing|aacantonese")), 5)
        .when(F.contains(lang, F.lit("hk")), 4)
        .when(F.startswith(lang, F.lit("zh")), 1)
        .otherwise(-1)
    )


def shown_in_script(text: Column, script: tuple[str, str]) -> Column:
    """The text in another script, unless that changes how many characters it has."""
    converted = F.translate(text, *script)
    return F.when(F.length(converted) == F.length(text), converted).otherwise(text)

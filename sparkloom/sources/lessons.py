"""Scans and sinks of lesson sets, curricula and reading dictionaries, as JSON documents."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# The formats that are written and read.
PAIRS = "array<struct<f:string,c:string>>"
SENTENCE = f"struct<id:int,paragraph_id:int,formal:string,colloquial:string,jyutping:array<string>,pairs:{PAIRS},audio:string>"
ARTICLE = f"struct<id:string,title:string,source:string,url:string,publishedAt:string,converted:boolean,method:string,verified:boolean,repaired:int,sentences:array<{SENTENCE}>>"
LESSONS = f"date string, source string, method string, note string, generatedAt string, sample boolean, articles array<{ARTICLE}>"
TITLE = "struct<en:string,hant:string,hans:string>"
LINE = "struct<id:int,paragraph_id:int,speaker:string,formal:string,colloquial:string,jyutping:array<string>,en:string,audio:string>"
SCENARIO = f"struct<id:string,emoji:string,level:int,title:{TITLE},sentences:array<{LINE}>>"
CURRICULUM = f"version int, categories array<struct<id:string,emoji:string,title:{TITLE},scenarios:array<{SCENARIO}>>>"
SPEAKER = "struct<raw:string,en:string,hant:string,hans:string>"


_LOCAL: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``, which all executors share; without the setting a
    temporary one on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sparkloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/lessons-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"


def read_document(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The JSON documents below a path, one for each file or line; none where it is absent, none for one that is not JSON."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def first_with(primary: DataFrame, fallback: DataFrame, items: str) -> DataFrame:
    """``primary`` where it has items, else ``fallback``; both have one row at most."""
    good = primary.where(F.size(items) > 0)
    n = F.broadcast(good.agg(F.count(F.lit(1)).alias("_n")))
    return good.unionByName(fallback.join(n).where("_n = 0").drop("_n"))


def read_lessons(spark: SparkSession, path: str, sample: str) -> DataFrame:
    return first_with(read_document(spark, path, LESSONS), read_document(spark, sample, LESSONS), "articles")


def read_curriculum(spark: SparkSession, path: str) -> DataFrame:
    """The curriculum, no row where it is absent or empty."""
    return read_document(spark, path, CURRICULUM).where(F.size("categories") > 0)


def speaker(text: Column) -> Column:
    """A speaker as (raw, en, hant, hans): its text is a name or a JSON object of names."""
    names = F.from_json(text, "en string, hant string, hans string")
    is_object = F.startswith(text, F.lit("{"))
    return F.struct(F.when(~is_object, text).alias("raw"), *[F.when(is_object, names[k]).alias(k) for k in ("en", "hant", "hans")]).cast(SPEAKER)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document, its rows few by construction."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_lessons(lessons: DataFrame, path: str) -> bool:
    """Writes a lesson set; nothing where it has no articles."""
    full = lessons.where(F.size("articles") > 0)
    if full.isEmpty():
        return False
    write_document(full, path)
    return True


def write_curriculum(curriculum: DataFrame, failed: DataFrame, path: str) -> bool:
    """Writes a curriculum; nothing where a check failed."""
    if not failed.isEmpty():
        return False
    write_document(curriculum, path)
    return True


def write_readings(readings: DataFrame, path: str) -> None:
    """(ch, readings) as one line of JSON for each character, its readings joined by blanks."""
    readings.select("ch", F.array_join("readings", " ").alias("readings")).write.mode("overwrite").json(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """(ch, readings); no rows where the dictionary is absent."""
    return read_document(spark, path, "ch string, readings string", lines=True).select("ch", F.split("readings", " ").alias("readings"))


def with_audio(lessons: DataFrame, produced: DataFrame, lines: DataFrame) -> DataFrame:
    """``lessons`` with the audio names of those sentences whose clip was produced (audio); others have none.

    ``lines`` are (article_id, sentence_id, audio) as asked for.
    """
    done = lines.join(produced.select("audio").distinct(), "audio", "left_semi").groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("sentence_id", "audio"))).alias("clips"))
    rows = lessons.withColumn("_set", F.lit(1)).select(*lessons.columns, "_set", F.posexplode("articles").alias("_i", "_a"))
    rows = rows.join(done, F.col("_a.id") == F.col("article_id"), "left")
    had = "audio" in lessons.schema["articles"].dataType.elementType["sentences"].dataType.elementType.names
    old = lambda s: s["audio"] if had else F.lit(None).cast("string")
    named = F.transform("_a.sentences", lambda s: s.withField("audio", F.coalesce(F.try_element_at("clips", s["id"]), old(s))))
    rows = rows.withColumn("_a", F.col("_a").withField("sentences", named))
    kept = [c for c in lessons.columns if c != "articles"]
    out = rows.groupBy("_set", *kept).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_a"))), lambda x: x["_a"]).alias("articles"))
    return out.select(*lessons.columns)


def summary(lessons: DataFrame) -> DataFrame:
    """(method, articles, sentences, repaired) of a lesson set."""
    a = lessons.select("method", F.explode("articles").alias("a"))
    return a.groupBy("method").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.size("a.sentences")).alias("sentences"), F.sum(F.coalesce("a.repaired", F.lit(0))).alias("repaired"))


def curriculum_summary(curriculum: DataFrame) -> DataFrame:
    """(categories, scenarios, lines)."""
    scen = F.flatten(F.transform("categories", lambda c: c["scenarios"]))
    lines = F.aggregate(scen, F.lit(0), lambda n, s: n + F.size(s["sentences"]))
    return curriculum.select(F.size("categories").alias("categories"), F.size(scen).alias("scenarios"), lines.alias("lines"))

"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of ``documents``.

Rows: decisions belong to rows, not to ids: rows are numbered for a stage, so that null and repeated ids
go through like any others.  Null and empty texts are scored like a text without evidence, are near no
other, hold no passage, and are mixed by whole copies.  Of repeated rows one stays.  Empty tables give
empty results.  Further columns pass through under any name; the last stage's own columns have an
underscore after their name where it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontam, toxicity
from sparkloom.llm.mixing import mix
from sparkloom.llm.near_dedup import near_groups
from sparkloom.llm.scratch import Stage
from sparkloom.llm.sharding import assign_shards
from sparkloom.llm.textcols import free_name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, the same whenever this table is read, and that column's name."""
    row = free_name(docs, "row_number_")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models predict toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxic_score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the least id (null last)."""
    rows, row = _numbered(docs)
    found = near_groups(rows, row=row)
    gone = Stage(spark, "gone").table(found.where("NOT first").select(F.col("rid").alias(row)), "rows")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    rows, row = _numbered(docs)
    times = free_name(docs, "times")
    taken = mix(rows, row=row).where("copies > 0").select(F.col("rid").alias(row), F.col("copies").cast("int").alias(times))
    taken = Stage(spark, "copies").table(taken, "copies")
    rows = rows.join(taken.hint("merge"), row)  # both sides grow alike
    return rows.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Models, signatures and random rounding are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.table(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

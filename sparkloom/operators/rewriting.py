"""Rewriting by models, from landed replies.

The engine calls no model.  ``requests`` says what to ask, a client outside Spark asks it, and its replies
land as a table; the operators here take replies to rewritten sentences.  Every failure is a null: of a
reply, then of its batch, then of its article, which falls to the next tier.

Tables: units (article_id, unit_id, formal); replies (article_id, batch_id, model, content, refused).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ModelSettings
from ..functions.clean import normalize_digits, parse_reply
from ..functions.chars import trim
from ..functions.rules import SEGMENT, valid_pairs
from ..functions.segment import batches

REWRITES = f"sentences array<struct<colloquial:string,pairs:array<{SEGMENT}>>>"
VERDICTS = f"verdicts array<struct<ok:boolean,fixed:string,fixed_pairs:array<{SEGMENT}>>>"
PLAIN = "sentences array<string>"


@dataclass(frozen=True)
class Prompt:
    """Who the model is, and what it is asked for ``{n}`` numbered items."""

    system: str
    user: str
    item: str


REWRITE = Prompt(
    "Rewrite written Chinese news as a Hong Kong television anchor would say it. Keep numbers as digits, names and terms. One sentence for each, in order. "
    "Give aligned pairs f and c: all f join to the written sentence, all c to the spoken one, character for character.",
    "Rewrite these {n} sentences; the array sentences has exactly {n} items.",
    "{k}. {formal}",
)
VERIFY = Prompt(
    "Check spoken rewrites of written Chinese news: natural, faithful, of an anchor's register. ok is true if all hold; else give fixed and fixed_pairs.",
    "Review these {n} rewrites; the array verdicts has exactly {n} items.",
    "{k}.\nFORMAL: {formal}\nCANTONESE: {colloquial}",
)
PLAIN_REWRITE = Prompt(
    "Rewrite written Chinese news as a Hong Kong television anchor would say it. Keep numbers as digits, names and terms. One sentence for each, in order. Answer with JSON alone: {\"sentences\": [...]}.",
    "Rewrite each of these {n} sentences; the array sentences has exactly {n} items, in order.",
    "{k}. {formal}",
)
REVIEW = Prompt(
    "Return the full list of rewrites, corrected where one is not natural or not faithful, and never less spoken. Answer with JSON alone: {\"sentences\": [...]}.",
    "Review these {n} rewrites and return the full corrected list.",
    "{k}.\nWRITTEN: {formal}\nCANTONESE: {colloquial}",
)


def batched(units: DataFrame, size: int) -> DataFrame:
    """``units`` with batch_id and place, by the order of unit_id, which counts an article's units from 0."""
    return units.withColumns({"batch_id": batches(F.col("unit_id") + 1, size), "place": (F.col("unit_id") % size).cast("int")})


def requests(units: DataFrame, prompt: Prompt, size: int) -> DataFrame:
    """(article_id, batch_id, n, system, user) to ask a model; a batch is at most ``size`` units."""

    def filled(template: str, **values: Column) -> Column:
        out = F.lit(template)
        for k, v in values.items():
            out = F.replace(out, F.lit(f"{{{k}}}"), v.cast("string"))
        return out

    said = F.col("colloquial") if "colloquial" in units.columns else F.lit("")
    item = F.struct("place", filled(prompt.item, k=F.col("place") + 1, formal=F.col("formal"), colloquial=F.coalesce(said, F.lit(""))).alias("text"))
    rows = batched(units, size).groupBy("article_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("xs"))
    between = "\n\n" if "\n" in prompt.item else "\n"
    return rows.select("article_id", "batch_id", "n", F.lit(prompt.system).alias("system"), F.concat(filled(prompt.user, n=F.col("n")), F.lit("\n\n"), F.array_join(F.transform("xs", lambda x: x["text"]), between)).alias("user"))


def structured(content: Column, refused: Column, schema: str) -> Column:
    """The reply as a struct; null if it was refused, is empty or is no JSON object."""
    return F.when(~F.coalesce(refused, F.lit(False)) & (F.coalesce(content, F.lit("")) != ""), parse_reply(content, schema))


def _by_place(units: DataFrame, replies: DataFrame, schema: str, items: str, size: int) -> DataFrame:
    """Units with ``said``, their item of the reply, and ``whole``: their batch's reply has as many items as the batch."""
    rows = batched(units, size)
    sizes = rows.groupBy("article_id", "batch_id").agg(F.count(F.lit(1)).alias("_n"))
    parsed = replies.select("article_id", "batch_id", structured(F.col("content"), F.col("refused"), schema)[items].alias("_items"))
    one = parsed.groupBy("article_id", "batch_id").agg(F.first("_items", ignorenulls=True).alias("_items"))  # one reply is expected for a batch
    known = sizes.join(one, ["article_id", "batch_id"], "left").withColumn("whole", F.coalesce(F.size("_items") == F.col("_n"), F.lit(False)))
    return rows.join(known, ["article_id", "batch_id"]).withColumn("said", F.get("_items", F.col("place"))).drop("_items", "_n")


def _spoken(text: Column) -> Column:
    return normalize_digits(trim(F.coalesce(text, F.lit(""))))


def _spoken_pairs(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["f"].alias("f"), normalize_digits(F.coalesce(p["c"], F.lit(""))).alias("c")))


def _whole_articles(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of those articles whose every batch is whole."""
    good = rows.groupBy("article_id").agg(F.bool_and("whole").alias("_good")).where("_good").select("article_id")
    return rows.join(good, "article_id", "left_semi").select(*keep)


def rewrite(units: DataFrame, replies: DataFrame, size: int = 30) -> DataFrame:
    """(article_id, unit_id, formal, colloquial, pairs) of the articles all of whose batches were answered in full.

    A blank rewrite keeps the written sentence; pairs that do not join to both sides are null.
    """
    rows = _by_place(units, replies, REWRITES, "sentences", size)
    said = _spoken(F.col("said.colloquial"))
    rows = rows.withColumn("_c", said)
    rows = rows.withColumn("colloquial", F.when(F.col("_c") == "", F.col("formal")).otherwise(F.col("_c")))
    rows = rows.withColumn("pairs", F.when(F.col("_c") != "", valid_pairs(_spoken_pairs(F.col("said.pairs")), F.col("formal"), F.col("_c"))))
    return _whole_articles(rows, ["article_id", "unit_id", "formal", "colloquial", "pairs"])


def verify(rewrites: DataFrame, replies: DataFrame, size: int = 30) -> DataFrame:
    """``rewrites`` with ok, as a second pass leaves them, of the articles it answered in full.

    A sentence that is not ok and has a fix takes it, and counts as repaired; a missing verdict is ok.
    """
    rows = _by_place(rewrites.withColumnsRenamed({"colloquial": "_was", "pairs": "_pairs"}), replies, VERDICTS, "verdicts", size)
    ok = F.coalesce(F.col("said.ok"), F.col("said").isNull())
    rows = rows.withColumn("_fix", F.when(~ok, _spoken(F.col("said.fixed"))).otherwise(""))
    fixed = F.col("_fix") != ""
    rows = rows.withColumns({
        "colloquial": F.when(fixed, F.col("_fix")).otherwise(F.col("_was")),
        "pairs": F.when(fixed, valid_pairs(_spoken_pairs(F.col("said.fixed_pairs")), F.col("formal"), F.col("_fix"))).otherwise(F.col("_pairs")),
        "ok": ok, "repaired": fixed,
    })
    return _whole_articles(rows, ["article_id", "unit_id", "formal", "colloquial", "pairs", "ok", "repaired"])


def convert(units: DataFrame, rewrites: DataFrame, verdicts: DataFrame, size: int = 30) -> DataFrame:
    """(article_id, unit_id, colloquial, pairs, verified, repaired) of tier 1: rewritten, and verified where the second pass was answered."""
    first = rewrite(units, rewrites, size)
    second = verify(first, verdicts, size).select("article_id", "unit_id", F.col("colloquial").alias("_c"), F.col("pairs").alias("_p"), F.col("repaired").alias("_r"))
    rows = first.join(second, ["article_id", "unit_id"], "left")
    seen = F.col("_r").isNotNull()
    return rows.select("article_id", "unit_id", F.when(seen, F.col("_c")).otherwise(F.col("colloquial")).alias("colloquial"), F.when(seen, F.col("_p")).otherwise(F.col("pairs")).alias("pairs"), seen.alias("verified"), F.coalesce("_r", F.lit(False)).alias("repaired"))


def ladder(units: DataFrame, replies: DataFrame, reviews: DataFrame, models: list[str], size: int = 20) -> DataFrame:
    """(article_id, unit_id, colloquial) of tier 2.

    A batch takes the first of the distinct ``models`` whose reply has as many sentences as it; an article with a
    batch that none answered is left out.  A review in full replaces the sentences it gives; else they stay.
    """
    order = F.array_distinct(F.array(*[F.lit(m) for m in models]))
    rows = batched(units, size)
    sizes = rows.groupBy("article_id", "batch_id").agg(F.count(F.lit(1)).alias("_n"))
    parsed = replies.join(sizes, ["article_id", "batch_id"]).select("article_id", "batch_id", F.array_position(order, F.col("model")).alias("rank"), structured(F.col("content"), F.col("refused"), PLAIN)["sentences"].alias("xs"), "_n")
    best = parsed.where((F.col("rank") > 0) & (F.size("xs") == F.col("_n"))).groupBy("article_id", "batch_id").agg(F.min_by("xs", "rank").alias("_xs"))
    review = reviews.join(sizes, ["article_id", "batch_id"]).select("article_id", "batch_id", structured(F.col("content"), F.col("refused"), PLAIN)["sentences"].alias("ys"), "_n")
    review = review.where(F.size("ys") == F.col("_n")).groupBy("article_id", "batch_id").agg(F.first("ys").alias("_ys"))
    rows = rows.join(sizes.join(best, ["article_id", "batch_id"], "left").join(review, ["article_id", "batch_id"], "left"), ["article_id", "batch_id"])
    mine = _spoken(F.get("_xs", F.col("place")))
    rows = rows.withColumn("_c", F.when(mine == "", F.col("formal")).otherwise(mine)).withColumn("_y", _spoken(F.get("_ys", F.col("place"))))
    rows = rows.withColumns({"colloquial": F.when(F.col("_y") == "", F.col("_c")).otherwise(F.col("_y")), "whole": F.col("_xs").isNotNull()})
    return _whole_articles(rows, ["article_id", "unit_id", "colloquial"])


def chat_outcomes(attempts: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """(model, call_ord, content, status, tried, waited_ms, skipped) of landed attempts, as a serial client takes them.

    attempts: (model, call_ord, attempt from 0, status, retry_after in seconds or null, content).  A call ends with
    its first attempt that is neither 429 nor a server's error, with a 429 whose wait is longer than the quota's, or
    with the last retry; it waits in between.  A 429 at its end breaks the circuit: that model's later calls are
    skipped.  A success gives its content, everything else null.
    """
    busy = (F.col("status") == 429) | (F.col("status") >= 500)
    long_wait = (F.col("status") == 429) & (F.coalesce("retry_after", F.lit(0)) > settings.quota_after_s)
    ends = ~busy | long_wait | (F.col("attempt") >= settings.retries)
    wait = F.when(F.coalesce("retry_after", F.lit(0)) > 0, F.col("retry_after") * 1000).otherwise((F.col("attempt") + 1) * settings.delay_ms)
    rows = attempts.withColumns({"_ends": ends, "_wait": F.least(wait.cast("long"), F.lit(settings.longest_wait_ms))})
    last = F.min(F.when(F.col("_ends"), F.struct("attempt", "status", "content")))
    calls = rows.groupBy("model", "call_ord").agg(last.alias("_last"), F.collect_list(F.struct("attempt", "_wait")).alias("_waits"))
    # An attempt that landed after the call's end was never made; a call whose end did not land is a failure.
    tried = F.filter("_waits", lambda w: F.col("_last").isNull() | (w["attempt"] < F.col("_last.attempt")))
    waited = F.aggregate(tried, F.lit(0).cast("long"), lambda n, w: n + w["_wait"])
    good = F.col("_last.status").between(200, 299)
    calls = calls.select("model", "call_ord", F.when(good, F.col("_last.content")).alias("content"), F.col("_last.status").alias("status"), (F.size(tried) + F.col("_last").isNotNull().cast("int")).alias("tried"), waited.alias("waited_ms"))
    broken = calls.where("status = 429").groupBy("model").agg(F.min("call_ord").alias("_from"))
    skipped = F.coalesce(F.col("call_ord") > F.col("_from"), F.lit(False))
    done = calls.join(broken, "model", "left").withColumn("skipped", skipped)
    or_none = lambda c, none: F.when(~F.col("skipped"), F.col(c)).otherwise(none).alias(c)
    return done.select("model", "call_ord", or_none("content", F.lit(None)), or_none("status", F.lit(None)), or_none("tried", F.lit(0)), or_none("waited_ms", F.lit(0)), "skipped")

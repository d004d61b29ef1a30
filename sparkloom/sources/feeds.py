"""Feed scans: landed XML payloads to article rows.  Fetching stays outside the engine.

A fetch that failed lands as a null payload and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import HAN, ScriptProfile, is_studyable, script_count
from ..functions.clean import clean_html_body, clean_text, container_body, fuller, item_body
from ..operators.select import first_n, first_per_key

# The daily feeds and their names, in order.
FEEDS = [
    ("https://rthk.hk/rthk/news/rss/c_expressnews_clocal.xml", "RTHK 本地"),
    ("https://rthk.hk/rthk/news/rss/c_expressnews_greaterchina.xml", "RTHK 兩岸"),
    ("https://rthk.hk/rthk/news/rss/c_expressnews_cinternational.xml", "RTHK 國際"),
    ("https://rthk.hk/rthk/news/rss/c_expressnews_cfinance.xml", "RTHK 財經"),
    ("https://rthk.hk/rthk/news/rss/c_expressnews_csport.xml", "RTHK 體育"),
]


def catalogue(spark: SparkSession, feeds: list[tuple[str, str]] = FEEDS) -> DataFrame:
    """(feed_ord, url, source)."""
    return spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(feeds)], "feed_ord int, url string, source string")


def landed(feeds: DataFrame, payloads: DataFrame) -> DataFrame:
    """(feed_ord, source, xml) of a catalogue and landed payloads (url, xml); feeds without one are skipped."""
    return feeds.join(payloads.where("xml IS NOT NULL").select("url", "xml"), "url").select("feed_ord", "source", "xml")


def tag(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)


def parse_items(feeds: DataFrame) -> DataFrame:
    """(feed_ord, source, item_ord, title, link, description, content, published), malformed XML tolerated."""
    items = F.regexp_extract_all("xml", F.lit(r"(?is)<item.*?</item>"), F.lit(0))
    rows = feeds.select("feed_ord", "source", F.posexplode(items).alias("item_ord", "x"))
    text = lambda n: clean_text(tag(F.col("x"), n))
    return rows.select(
        "feed_ord", "source", "item_ord", text("title").alias("title"), text("link").alias("link"), text("description").alias("description"),
        clean_html_body(tag(F.col("x"), "content:encoded")).alias("content"), text("pubDate").alias("published"),
    )


def studyable_items(feeds: DataFrame, per_feed: int, min_chars: int = 20, p: ScriptProfile = HAN) -> DataFrame:
    """The first studyable items of each feed, by their description."""
    rows = parse_items(feeds).withColumn("body", item_body(F.col("description"))).where(is_studyable(F.col("body"), p, min_chars))
    return first_n(rows, per_feed, ["feed_ord"], F.col("item_ord"))


def primary_articles(feeds: DataFrame, per_feed: int = 8, min_chars: int = 20, p: ScriptProfile = HAN) -> DataFrame:
    """Studyable items, capped per feed and then first-wins by url or title."""
    key = F.coalesce(F.nullif(F.col("link"), F.lit("")), F.col("title"))
    return first_per_key(studyable_items(feeds, per_feed, min_chars, p), key, F.col("feed_ord"), F.col("item_ord"))


def fetched_articles(feeds: DataFrame, payloads: DataFrame, per_feed: int = 8, min_chars: int = 10, p: ScriptProfile = HAN) -> DataFrame:
    """(feed_ord, item_ord, title, body, url, published, source) of a catalogue's landed payloads."""
    rows = primary_articles(landed(feeds, payloads), per_feed, min_chars, p)
    return rows.select("feed_ord", "item_ord", "title", "body", F.col("link").alias("url"), "published", "source")


def custom_articles(feeds: DataFrame, most: int = 4, p: ScriptProfile = HAN, min_chars: int | None = None) -> DataFrame:
    """Items whose body is the content if it has strictly more of the script; no de-duplication."""
    body = F.when(script_count(F.col("content"), p) > script_count(F.col("description"), p), F.col("content")).otherwise(F.col("description"))
    rows = parse_items(feeds).withColumn("body", body).where(is_studyable(F.col("body"), p, min_chars))
    return first_n(rows, most, ["feed_ord"], F.col("item_ord"))


def with_fuller_bodies(articles: DataFrame, pages: DataFrame, p: ScriptProfile = HAN) -> DataFrame:
    """``articles`` with the body of their landed page (url, html) where that has more of the script."""
    asked = pages.join(articles.select("url").distinct(), "url", "left_semi")  # pages that no article has are not read on
    full = F.coalesce(container_body(F.col("html")), F.lit(""))
    found = asked.select("url", full.alias("_full")).groupBy("url").agg(F.max("_full").alias("_full"))
    joined = articles.join(found, "url", "left")
    return joined.withColumn("body", fuller(F.col("body"), F.coalesce("_full", F.lit("")), p)).select(*articles.columns)


def only_new(articles: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``articles`` whose key no earlier run has emitted."""
    return articles.join(seen.select(key).distinct(), key, "left_anti")

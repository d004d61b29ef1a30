"""News search: wrapped results to articles, from landed pages.  Fetching stays outside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import HAN, ScriptProfile, script_count
from ..functions.clean import article_body, clean_title, hostname
from ..operators.select import greedy_two_key
from .feeds import parse_items

CANDIDATES, MOST, LEAST_CHARS = 12, 4, 80


def wrapped_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/articles/([^?/]+)", 1)


def splash_stamp(splash: Column) -> Column:
    return F.regexp_extract(splash, r'data-n-a-ts="([^"]+)"', 1)


def splash_signature(splash: Column) -> Column:
    return F.regexp_extract(splash, r'data-n-a-sg="([^"]+)"', 1)


def reply_url(reply: Column) -> Column:
    plain = F.replace(reply, F.lit("\\/"), F.lit("/"))
    return F.regexp_extract(plain, r'garturlres\\?",\\?"(https?:[^"\\]+)', 1)


def resolve_links(wrapped: DataFrame) -> DataFrame:
    """(link, url) of landed (link, splash, reply): null unless every step of the way succeeded."""
    whole = (wrapped_id(F.col("link")) != "") & (splash_stamp(F.col("splash")) != "") & (splash_signature(F.col("splash")) != "")
    return wrapped.select("link", F.when(whole, F.nullif(reply_url(F.col("reply")), F.lit(""))).alias("url"))


def search_articles(feeds: DataFrame, links: DataFrame, pages: DataFrame, p: ScriptProfile = HAN, candidates: int = CANDIDATES, most: int = MOST, least: int = LEAST_CHARS) -> DataFrame:
    """(feed_ord, ord, title, body, url, published): the first ``candidates`` results of a feed in order, with their page's
    prose, of which none shares the start of its title or its host with one before it.

    links: (link, url); pages: (url, html).  Results without title, link, page or enough prose are passed over.
    """
    items = parse_items(feeds).where(F.col("item_ord") < candidates).withColumn("title", clean_title(F.col("title")))
    rows = items.where("title <> ''").join(links.where("url IS NOT NULL").groupBy("link").agg(F.min("url").alias("url")), "link")
    rows = rows.withColumn("host", hostname(F.col("url"))).where("host IS NOT NULL")
    asked = pages.join(rows.select("url").distinct(), "url", "left_semi").select("url", article_body(F.coalesce("html", F.lit("")), p).alias("body"))
    rows = rows.join(asked.groupBy("url").agg(F.max("body").alias("body")), "url", "left").withColumn("body", F.coalesce("body", F.lit("")))
    rows = rows.withColumn("n", script_count(F.col("body"), p))
    picked = greedy_two_key(rows, "item_ord", "title", "host", "n", group="feed_ord", candidates=candidates, least=least, most=most)
    return picked.select("feed_ord", F.col("ord").alias("item_ord")).join(rows, ["feed_ord", "item_ord"]).select("feed_ord", F.col("item_ord").alias("ord"), "title", "body", "url", "published")

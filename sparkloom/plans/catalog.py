"""The registered queries of the engine.

The driver's tables hold no Han text.  Table queries run the LATIN profile, or the HAN profile over the
tables' texts written with Han letters (``fixtures.HAN_TO``); formats that the tables do not have run on
the literal inputs of ``fixtures``.  ``oracles`` states each of them in SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import chars, clean, numerals, rules, segment
from ..operators import align, curriculum, dialogue, quality, rewriting, select
from ..sources import feeds, search
from ..sources import lessons as files
from ..streaming import speech
from . import fixtures as X
from . import lessons, oracles

L, H = chars.LATIN, chars.HAN
ORACLE = oracles.ORACLE
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _texts(spark: SparkSession) -> DataFrame:
    return _values(spark, X.HAN_TEXTS, "id int, t string")


def _han(c: Column) -> Column:
    return F.replace(F.translate(c, X.HAN_FROM, X.HAN_TO), F.lit(" "), F.lit(""))


def _han_docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", _han(F.coalesce("text", F.lit(""))).alias("t"))


def _turns(spark: SparkSession, d: str, han: bool) -> DataFrame:
    text = _han(F.col("text")) if han else F.col("text")
    return _t(spark, d, "conversations").where("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("k"), text.alias("t"))


def _readings(table: list[tuple[str, list[str]]]) -> Column:
    return F.create_map(*[x for ch, rs in table for x in (F.lit(ch), F.array(*[F.lit(r) for r in rs]))])


def _spoken_readings() -> Column:
    return _readings([(ch, [r]) for ch, r in X.SPOKEN_READINGS.items()])


# Measures, cleaning, segmentation


@query
def char_measures(spark, d):
    t = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = F.col("text")
    return t.select("doc_id", chars.script_count(c, L).alias("letters"), F.round(chars.script_fraction(c, L), 6).alias("fraction"), F.round(chars.digit_density(c), 6).alias("density"))


@query
def han_measures(spark, d):
    m = chars.measures(F.col("t"))
    return _han_docs(spark, d).select(
        "doc_id", m["script"].alias("han"), F.round(m["fraction"], 6).alias("fraction"), F.round(m["density"], 6).alias("density"), m["studyable"].alias("studyable"), F.round(m["score"], 4).alias("score")
    )


@query
def han_texts(spark, d):
    c = F.col("t")
    return _texts(spark).select(
        "id", chars.script_count(c).alias("han"), F.round(chars.script_fraction(c), 6).alias("fraction"), chars.is_studyable(c).alias("studyable"), chars.has_digits(c).alias("digits"),
        chars.only_script(c).alias("only"), chars.is_shown_with_reading(c).alias("shown"),
    )


@query
def studyable_filter(spark, d):
    return _t(spark, d, "documents").where(chars.is_studyable(F.col("text"), L, 200)).select("doc_id")


@query
def split_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.posexplode(segment.sentences(F.col("text"), L)).alias("pos", "sentence"))


@query
def han_sentences(spark, d):
    t = _han_docs(spark, d).select("doc_id", segment.sentences(F.col("t")).alias("s"))
    return t.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def _unit_digest(rows: DataFrame) -> DataFrame:
    formal = F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "unit_id", "formal"))), lambda x: x["formal"])
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("units"), F.sum("chars").cast("long").alias("letters"), F.md5(F.array_join(formal, "|").cast("binary")).alias("digest"))


@query
def pack_units(spark, d):
    return _unit_digest(lessons.units(_turns(spark, d, False), "k", "t", L))


@query
def han_units(spark, d):
    return _unit_digest(lessons.units(_turns(spark, d, True), "k", "t"))


@query
def page_paragraphs(spark, d):
    t = _t(spark, d, "pages")
    return t.select("page_id", F.posexplode(clean.page_paragraphs(F.col("html"))).alias("pos", "paragraph")).where("paragraph <> ''")


@query
def article_bodies(spark, d):
    return _t(spark, d, "pages").select("page_id", clean.article_body(F.col("html"), L).alias("body"))


@query
def han_bodies(spark, d):
    return _values(spark, X.PAGES, "id int, html string").select("id", clean.article_body(F.col("html")).alias("body"))


@query
def junk_filter(spark, d):
    return _values(spark, X.JUNK_ROWS, "id int, p string").select("id", clean.is_junk(F.col("p")).alias("junk"))


@query
def strip_junk(spark, d):
    rows = _values(spark, X.JUNK_ROWS, "id int, p string").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("xs"))
    return rows.select(clean.strip_junk(F.array_join(F.transform("xs", lambda x: x["p"]), "\n\n")).alias("body"))


@query
def clean_titles(spark, d):
    return _values(spark, X.TITLES, "id int, t string").select("id", clean.clean_title(F.col("t")).alias("title"))


# Feeds, pages, search


def _feeds(spark):
    return _values(spark, X.XML, "feed_ord int, source string, xml string")


@query
def feed_catalogue(spark, d):
    return feeds.catalogue(spark)


@query
def rss_items(spark, d):
    return feeds.parse_items(_feeds(spark)).select("feed_ord", "item_ord", "title", "link", "description", "content", "published")


@query
def fetched_articles(spark, d):
    known = feeds.catalogue(spark, [(f"http://{s}", s) for _, s, _ in X.XML])
    return feeds.fetched_articles(known, _feeds(spark).select(F.concat(F.lit("http://"), "source").alias("url"), "xml"), min_chars=20)


@query
def custom_feed(spark, d):
    return feeds.custom_articles(_feeds(spark)).select("feed_ord", "item_ord", "title", "body")


@query
def resolved_links(spark, d):
    return search.resolve_links(_values(spark, X.WRAPPED, "link string, splash string, reply string"))


@query
def search_articles(spark, d):
    found = _values(spark, [(0, "s", X.SEARCH_XML)], "feed_ord int, source string, xml string")
    out = search.search_articles(found, resolved_links(spark, d), _values(spark, X.SEARCH_PAGES, "url string, html string"))
    return out.select(F.col("ord").cast("int").alias("ord"), "title", "body", "url", "published")


@query
def full_bodies(spark, d):
    articles = _values(spark, [(1, "http://a", "短。"), (2, "http://b", "沒有頁面。"), (3, "http://a", "很長的文字" * 30)], "id int, url string, body string")
    return feeds.with_fuller_bodies(articles, _values(spark, [("http://a", X.STORY)], "url string, html string")).select("id", "body")


@query
def news_scores(spark, d):
    return _texts(spark).select("id", F.round(chars.news_score(F.col("t"), F.lit("")), 4).alias("score"))


@query
def hostnames(spark, d):
    return _t(spark, d, "pages").select("page_id", clean.hostname(F.col("url")).alias("host"))


# De-duplication and picks


@query
def dedup_first_wins(spark, d):
    t = _t(spark, d, "documents")
    return select.first_per_key(t.withColumn("h", F.sha2("text", 256)), F.col("h"), F.col("doc_id")).select("doc_id", "source")


@query
def dedup_greedy(spark, d):
    t = _t(spark, d, "pages").select("page_id", clean.hostname(F.col("url")).alias("host"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.length("html").alias("n"))
    return select.greedy_two_key(t, "page_id", "title", "host", "n").select(F.col("ord").alias("page_id"), F.col("t").alias("prefix"), F.col("d").alias("host"))


@query
def balanced_pick(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return select.balanced(t, "source", "doc_id", F.col("n_chars"), 12).select("doc_id", "source", "rk")


@query
def first_per_source(spark, d):
    return select.first_n(_t(spark, d, "documents").select("doc_id", "source"), 3, ["source"], F.col("doc_id"))


@query
def relaxed_pool(spark, d):
    return select.relaxed_pool(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 8000, 4000, 200).select("doc_id")


@query
def guaranteed_lanes(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "lang")
    return select.lanes(t.where("lang = 'de'"), t.where("lang <> 'de'"), ["doc_id"]).select("doc_id", "lane")


@query
def new_articles(spark, d):
    return feeds.only_new(_t(spark, d, "documents").select("doc_id", "source"), _t(spark, d, "labels"), "doc_id")


def _voices(spark):
    return _values(spark, X.VOICES, "id int, lang string, name string")


@query
def voice_scores(spark, d):
    return _voices(spark).select("id", dialogue.voice_score(F.col("lang"), F.col("name")).alias("score"))


@query
def best_voice(spark, d):
    return select.best_voice(_voices(spark), dialogue.voice_score(F.col("lang"), F.col("name")), "id").select("id", "score")


# Rewriting and numerals


def _sides(pairs: str, f: str, c: str) -> list[Column]:
    return [F.array_join(F.transform(pairs, lambda p: p[k]), "|").alias(n) for k, n in (("f", f), ("c", c))]


@query
def rules_rewrite(spark, d):
    return _texts(spark).withColumn("ps", rules.segments(F.col("t"))).select("id", *_sides("ps", "formal", "colloquial"))


@query
def loaded_rules(spark, d):
    """Texts rewritten by a landed table of rules."""
    table = rules.load_rules(_values(spark, X.RULES, "k string, v string, kind string"))
    return _texts(spark).select("id", rules.rewrite(F.col("t"), table).alias("colloquial"))


@query
def han_rewrite(spark, d):
    return _turns(spark, d, True).select("k", rules.rewrite(F.col("t")).alias("colloquial"))


@query
def cardinal_reading(spark, d):
    n = F.col("o_orderkey") * 7919 * (F.col("o_orderkey") % 100003)
    rows = _values(spark, [(n,) for n in X.NUMBERS], "n string").unionByName(_t(spark, d, "orders").select(n.cast("string").alias("n")))
    return rows.select("n", numerals.cardinal_reading(F.col("n")).alias("reading"))


def _spell_rows(spark):
    return _values(spark, X.SPELL, "id int, t string, a string")


@query
def spell_numbers(spark, d):
    return _spell_rows(spark).select("id", numerals.spell_out(clean.normalize_digits(F.col("t")), F.col("a")).alias("spelled"))


@query
def spell_orders(spark, d):
    t = _t(spark, d, "orders").select("o_orderkey", F.expr(oracles.order_text()).alias("t"))
    return t.select("o_orderkey", "t", numerals.spell_out(F.col("t")).alias("spelled"))


@query
def spell_pairs(spark, d):
    return _spell_rows(spark).withColumn("ps", numerals.spell_out_pairs(rules.segments(F.col("t")))).select("id", *_sides("ps", "formal", "spoken"))


@query
def number_runs(spark, d):
    rows = _spell_rows(spark).select("id", F.posexplode(numerals.split_by_numbers(F.col("t"))).alias("pos", "x"))
    return rows.select("id", "pos", F.col("x.text").alias("run"), F.col("x.num").alias("num"))


@query
def digits_reading(spark, d):
    return _t(spark, d, "part").select("p_partkey", numerals.digits_reading(F.col("p_partkey").cast("string")).alias("reading"))


# Alignment, grading, quality


@query
def align_invariants(spark, d):
    t = _texts(spark).select("id", F.col("t").alias("f"), rules.rewrite(F.col("t")).alias("c"))
    t = t.withColumn("pairs", align.align_pairs("f", "c"))
    side = lambda k: F.coalesce(F.array_join(F.transform("pairs", lambda p: p[k]), ""), F.lit(""))
    return t.select("id", side("f").alias("formal"), side("c").alias("colloquial"), rules.valid_pairs(F.col("pairs"), F.col("f"), F.col("c")).isNotNull().alias("ok"))


@query
def grade_attempts(spark, d):
    rows = _values(spark, X.ATTEMPTS, "id int, t string, h string")
    t = align.grade(rows, "t", "h", _readings(X.READINGS), script=X.SCRIPT, lookup=X.SCRIPT[::-1])
    marks = F.array_join(F.transform("marks", align.mark_class), ",")
    return t.select("id", F.round("accuracy", 4).alias("accuracy"), align.band(F.col("accuracy")).alias("band"), F.col("heard_text").alias("heard"), marks.alias("marks"))


def _quality(spark):
    t = _values(spark, X.QUALITY, "id int, f string, c string, j array<string>, p array<struct<f:string,c:string>>")
    own = quality.sentence_rules(F.col("f"), F.col("c"), F.col("j"), F.col("p"))
    return quality.failures(t, "id", own), list(own)


@query
def sentence_quality(spark, d):
    return _quality(spark)[0]


@query
def quality_counts(spark, d):
    return quality.failure_counts(*_quality(spark))


# Dialogue, curriculum, labels


@query
def dialogue_voices(spark, d):
    v = dialogue.assign_voices(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return v.select("conv_id", "turn", "role", "voice", dialogue.audio_name(F.col("text"), F.col("voice")).alias("audio"))


def _source(spark):
    text = _values(spark, [(json.dumps(X.CURRICULUM, ensure_ascii=False),)], "j string")
    return text.select(F.from_json("j", curriculum.SOURCE).alias("x")).select("x.*")


def _curriculum(spark):
    return curriculum.build(_source(spark), _spoken_readings())


@query
def curriculum_checks(spark, d):
    return curriculum.source_failures(_source(spark))


@query
def curriculum_built(spark, d):
    s = _curriculum(spark).select(F.explode("categories").alias("c")).select(F.coalesce("c.id", F.lit("?")).alias("cat"), F.explode("c.scenarios").alias("s"))
    x = s.select("cat", F.col("s.id").alias("scenario"), F.col("s.emoji").alias("emoji"), F.col("s.level").alias("level"), F.explode("s.sentences").alias("x"))
    return x.select("cat", "scenario", "emoji", "level", F.col("x.id").alias("line"), "x.formal", "x.colloquial", "x.en", F.array_join("x.jyutping", " ").alias("jyutping"))


@query
def conversation_checks(spark, d):
    return quality.conversation_failures(_curriculum(spark))


@query
def scenario_articles(spark, d):
    return curriculum.as_articles(_curriculum(spark), "en", "Talk").select("id", "title", "source", F.size("sentences").alias("lines"))


@query
def curriculum_summary(spark, d):
    return files.curriculum_summary(_curriculum(spark))


@query
def curriculum_files(spark, d):
    """A curriculum read from its source, checked, built, written as a document, read again and summed up."""
    top = files.new_folder(spark)
    _values(spark, [(json.dumps(X.GOOD_SOURCE, ensure_ascii=False),)], "value string").write.text(f"{top}/source")
    source = files.read_document(spark, f"{top}/source", curriculum.SOURCE)
    written = files.write_curriculum(curriculum.build(source, _spoken_readings()), curriculum.source_failures(source), f"{top}/built")
    return files.curriculum_summary(files.read_curriculum(spark, f"{top}/built")).withColumn("written", F.lit(written))


@query
def dialogue_audio(spark, d):
    return dialogue.dialogue_lines(_curriculum(spark)).select("article_id", "sentence_id", "text", "voice", "audio")


@query
def speaker_names(spark, d):
    rows = _values(spark, X.SPEAKERS, "id int, sp string")
    return rows.select("id", dialogue.speaker_name(files.speaker(F.col("sp")), "hans").alias("name"))


@query
def labels(spark, d):
    rows = _values(spark, [("lines",), ("sentenceOf",), ("only",), ("none",)], "k string")
    out = dialogue.label(rows, F.col("k"), _values(spark, X.LABELS, "key string, lang string, text string"), "hant")
    return out.select("k", dialogue.filled(F.col("label"), F.lit(3), F.lit(9)).alias("label"))


@query
def level_names(spark, d):
    return spark.range(5).select(F.col("id").cast("int").alias("level"), dialogue.level_name(F.col("id").cast("int"), "hant").alias("name"))


@query
def shown_in_script(spark, d):
    return _texts(spark).select("id", dialogue.shown_in_script(F.col("t"), X.SCRIPT).alias("shown"))


# Model replies and lessons


@query
def tier_fallback(spark, d):
    rows = [(1, "a", "A", None, "r"), (2, "a", None, "a", "r"), (3, "a", None, "B", "r"), (4, "a", None, None, "r")]
    t = _values(spark, rows, "id int, f string, t1 string, t2 string, r string")
    return t.select("id", select.tiered(F.col("f"), F.col("t1"), F.col("t2"), F.col("r")).alias("x")).select("id", "x.text", "x.method")


@query
def json_replies(spark, d):
    x = rewriting.structured(F.col("t"), F.lit(False), rewriting.PLAIN)
    return _values(spark, X.REPLIES, "id int, t string").select("id", x.isNotNull().alias("parsed"), F.array_join(x["sentences"], "|").alias("sentences"))


def _units(spark):
    return _values(spark, X.UNITS, "article_id string, unit_id int, formal string")


def _replies(spark, rows):
    return _values(spark, rows, "article_id string, batch_id int, model string, content string, refused boolean")


def _tiers(spark):
    one = rewriting.convert(_units(spark), _replies(spark, X.REWRITTEN), _replies(spark, X.VERDICTS), 2)
    two = rewriting.ladder(_units(spark), _replies(spark, X.PLAIN_REPLIES), _replies(spark, X.REVIEWS), ["big", "small", "big"], 2)
    return one, two


@query
def model_requests(spark, d):
    return rewriting.requests(_units(spark), rewriting.PLAIN_REWRITE, 2)


@query
def tier1_rewrites(spark, d):
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["f"], F.lit(">"), p["c"])), "|")
    return _tiers(spark)[0].select("article_id", "unit_id", "colloquial", pairs.alias("pairs"), "verified", "repaired")


@query
def tier2_rewrites(spark, d):
    return _tiers(spark)[1]


@query
def chat_outcomes(spark, d):
    return rewriting.chat_outcomes(_values(spark, X.CHAT, "model string, call_ord int, attempt int, status int, retry_after int, content string"))


@query
def daily_articles(spark, d):
    schema = "ord int, title string, body string, url string, published string, source string"
    chosen = lessons.choose(_values(spark, X.CANDIDATES, schema), _values(spark, X.SECONDARY, schema), chars.news_score(F.col("title"), F.col("body")))
    return chosen.select("article_id", "title", F.md5(F.col("body").cast("binary")).alias("body"), "source")


def _sentences(spark):
    return lessons.sentences(_units(spark).withColumn("paragraph_id", F.lit(0)), *_tiers(spark), _spoken_readings())


def _built(spark):
    articles = _values(spark, [(f"a{i}", f"題{i}", "s", f"http://{i}", None) for i in range(4)], "article_id string, title string, source string, url string, published string")
    return lessons.build(articles, _sentences(spark))


def _set(spark):
    return lessons.lesson_set(_built(spark), EngineConfig(date="2026-07-01", source="甲"), "乙")


def _written(spark):
    """The set as it is read again from its document."""
    path = files.new_folder(spark)
    files.write_lessons(_set(spark), path)
    return files.read_lessons(spark, path, path)


@query
def lesson_sentences(spark, d):
    return _sentences(spark).select("article_id", "unit_id", "formal", "colloquial", F.array_join("jyutping", " ").alias("jyutping"), "method")


@query
def lesson_articles(spark, d):
    built = _built(spark)
    off = lessons.unavailable(built, F.lit("llm+verify"))
    return built.select("id", "converted", "method", "verified", "repaired", F.size("sentences").alias("sentences"), off.alias("unavailable"))


@query
def lesson_files(spark, d):
    """A set written as a document, read again and summed up."""
    back = _written(spark)
    return files.summary(back).join(back.select("note")).select("method", "note", "articles", "sentences", "repaired")


@query
def lesson_checks(spark, d):
    return quality.lesson_failures(_written(spark), "daily")


@query
def lesson_fallback(spark, d):
    """Which document is read where the daily one is absent, empty, broken or full."""
    top = files.new_folder(spark)
    one = lambda name, n: _values(spark, [(name, [("a",)] * n)], "source string, articles array<struct<id:string>>")
    files.write_document(one("sample", 1), f"{top}/sample")
    files.write_document(one("daily", 0), f"{top}/empty")
    files.write_document(one("daily", 1), f"{top}/full")
    _values(spark, [("{not json",)], "value string").write.mode("overwrite").text(f"{top}/broken")
    out = None
    for name in ("absent", "empty", "broken", "full"):
        part = files.read_lessons(spark, f"{top}/{name}", f"{top}/sample").select(F.lit(name).alias("daily"), "source")
        out = part if out is None else out.unionByName(part)
    return out


@query
def news_audio(spark, d):
    return dialogue.news_lines(_set(spark))


@query
def audio_injected(spark, d):
    back = _written(spark)
    lines = dialogue.news_lines(back)
    done = files.with_audio(back, lines.where("sentence_id % 2 = 0"), lines)
    rows = done.select(F.explode("articles").alias("a")).select(F.col("a.id").alias("article_id"), F.explode("a.sentences").alias("s"))
    return rows.select("article_id", F.col("s.id").alias("sentence_id"), F.col("s.audio").alias("audio"))


@query
def paragraph_groups(spark, d):
    rows = lessons.units(_turns(spark, d, True), "k", "t").withColumnRenamed("k", "article_id").withColumn("colloquial", F.col("formal"))
    digest = F.md5(F.array_join(F.transform("lines", lambda x: x["formal"]), "|").cast("binary"))
    return lessons.paragraph_groups(rows).select(F.col("article_id").alias("k"), "paragraph_id", F.size("lines").alias("lines"), digest.alias("digest"))


@query
def reading_dictionary(spark, d):
    path = files.new_folder(spark)
    files.write_readings(quality.distinct_readings(_values(spark, X.READING_ROWS, "ch string, ord int, syllable string")), path)
    return files.read_readings(spark, path).select("ch", F.array_join("readings", " ").alias("readings"))


# Speech


@query
def speech_sessions(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id"), F.col("ts"))
    return speech.sessions(e, "user_id", "ts", "30 minutes").select("user_id", F.date_format("stop", "yyyy-MM-dd HH:mm:ss").alias("stop"), "n")


def speech_events(spark: SparkSession) -> DataFrame:
    e = _values(spark, X.SPEECH, "session_id string, t double, ord int, kind string, final string, interim string, error string")
    return e.withColumn("ts", F.timestamp_seconds("t")).drop("t")


@query
def speech_listen(spark, d):
    at = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    return speech.listen(speech_events(spark)).select("session_id", at("start"), at("stop"), "reason", "transcript")


@query
def lesson_units(spark, d):
    """The chain: pages to prose to units, and Han texts rewritten beside them."""
    prose = _t(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("k"), F.posexplode(clean.article_paragraphs(F.col("html"), L)).alias("paragraph_id", "x"))
    latin = prose.select("k", "paragraph_id", F.posexplode(segment.pack(F.col("x"), L)).alias("unit_id", "u")).select("k", "paragraph_id", "unit_id", F.col("u.text").alias("formal"), F.col("u.chars").alias("chars"))
    han = lessons.units(_texts(spark).select(F.concat(F.lit("han-"), "id").alias("k"), F.col("t").alias("body")), "k", "body")
    return lessons.lesson_sentences(han).unionByName(latin.withColumn("colloquial", F.col("formal")), allowMissingColumns=True).drop("pairs")

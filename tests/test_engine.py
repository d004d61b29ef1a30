"""Golden values of the text operators, invariants of the alignment, and every query against its SQL."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.config import EngineConfig
from sparkloom.functions import chars, clean, folds, numerals, rules, segment
from sparkloom.operators import align, dialogue, quality, rewriting, select
from sparkloom.plans import catalog, oracles
from sparkloom.plans import fixtures as X
from sparkloom.sources import feeds, search
from sparkloom.sources import lessons as files
from sparkloom.streaming import speech

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, col_of, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, t string").select("i", col_of(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def test_cardinals(spark):
    want = "零 七 十 十三 三十 一百零五 一百一十 四百 一千零五 二千零二十 一萬 一萬零五百 二萬五千 一萬二千三百四十五 一億 二億五千零六萬 十二 一二三四五六七八九零一二三四五六七".split()
    assert one(spark, numerals.cardinal_reading, *X.NUMBERS[:18]) == want


def test_spelled_numbers(spark):
    want = {
        1: "二零二零年", 2: "一九九七年香港回歸", 3: "賣出二千零二十個", 4: "五年計劃", 5: "三十年", 6: "七月三日", 7: "十二月二十五號", 8: "升百分之十五", 9: "跌百分之三點五", 10: "指數報三點七五", 11: "一千二百三十四人",
        12: "恒指報二萬五千點", 13: "二零二零至二零二一年", 14: "二零二零至二一年", 15: "熱線二八四六三二二二", 16: "到二零二零", 17: "賣出五百", 18: "恒生指數今日高開。", 19: "（TYO:九四三三）", 20: "編號：二零四六",
        21: "賣出九千四百三十三個", 22: "每股三千三百八十四日圓", 23: "二千零二十—二一年", 24: "二零二零年至二十一年", 25: "二千八百四十六 三千二百二十二", 26: "二千零二十至 二零二一年", 28: "五百買", 29: "二千零二十年", 30: "十:三零",
    }
    got = {r["id"]: r["spelled"] for r in catalog.QUERIES["spell_numbers"](spark, SF).collect()}
    assert {k: got[k] for k in want} == want


def test_normalized_digits(spark):
    assert one(spark, clean.normalize_digits, "每股3，384日圓", "升１５％", "報３．５", "條款，貝恩", "1，2，3") == ["每股3,384日圓", "升15%", "報3.5", "條款，貝恩", "1,2,3"]


def test_rewrite_protects_and_quotes(spark):
    assert one(spark, rules.rewrite, "他們的目的", "「他的」是他的", "他走了。", "他走了三次") == ["佢哋嘅目的", "「他的」係佢嘅", "佢走喇。", "佢走咗三次"]
    got = one(spark, rules.segments, "市場認為他們現在不足以應付")[0]
    assert [tuple(p) for p in got if p["f"] != p["c"]] == [("認為", "覺得"), ("他們", "佢哋"), ("現在", "而家")]


def test_rules_are_loaded(spark):
    table = spark.createDataFrame([("他", "佢", "char"), ("他們", "佢哋", "phrase"), ("其他", None, "protect"), ("了解", "x", "phrase"), ("了解", None, "protect"), ("", "y", "char")], "k string, v string, kind string")
    found = rules.load_rules(table)
    assert found == {"他": "佢", "他們": "佢哋", "其他": "其他", "了解": "了解"} and rules.keys_longest_first(found)[-1] == "他"
    assert one(spark, lambda c: rules.rewrite(c, found), "其他人了解他們和他") == ["其他人了解佢哋和佢"]


def test_junk_and_titles(spark):
    junk = [
        "網頁已經閒置了一段時間，為確保不會錯過最新的內容。請重新載入頁面。立即重新載入", "《經濟通》所刊的署名及/或不署名文章，相關內容屬作者個人意見，並不代表《經濟通》立場。", "本網頁內容版權所有，未經授權不得轉載。",
        "請先登入或成為會員，即可閱讀全文。", "立即訂閱我們的電子報，緊貼市場動態。", "本網站使用Cookies以提升瀏覽體驗，繼續使用即表示同意私隱政策。", "請啟用JavaScript以獲得最佳瀏覽體驗。", "使用Cookies以改善", " ", "All Rights Reserved",
    ]
    prose = ["協合新能源與貝恩資本旗下Bridge Data Centres今日簽署諒解備忘錄，共同開發數據中心項目。", "行政長官表示，政府會繼續推動創新科技發展，吸引更多企業落戶香港。", "恒生指數今日收市升200點，成交額增加。", "plain words"]
    assert one(spark, clean.is_junk, *junk, *prose, None) == [True] * len(junk) + [False] * len(prose) + [None]
    assert one(spark, clean.clean_title, "要點 ｜ 首頁 | 新聞", "世界盃｜決賽", "公司公布業績 - 經濟日報") == ["要點", "世界盃｜決賽", "公司公布業績"]


def test_bodies(spark):
    got = {r["id"]: r["body"] for r in catalog.QUERIES["han_bodies"](spark, SF).collect()}
    assert "貝恩資本今日宣布" in got[1] and "管理層表示" in got[1] and "\n\n" in got[1] and not any(x in got[1] for x in ("跳至導覽", "English-only", "版權所有"))
    assert got[2].startswith("該銀行預計") and "營運總部" not in got[3] and got[4] is None and got[5] == ""
    assert got[6].count("\n\n") == 1
    assert one(spark, clean.container_body, X.STORY, "<html>nothing</html>") == ["港股顯著造好，恒生指數重返23000點以上。\n\n金融及科技股推高大市，美團升近6%，成交額超過一千億元，投資者情緒明顯改善。", ""]
    assert one(spark, clean.clean_html_body, "<p>第一段。</p><p>第二段。</p>") == ["第一段。\n\n第二段。"]


def test_clean_text(spark):
    assert one(spark, clean.decode_entities, "&amp;lt;", "a&nbsp;b&#039;") == ["&lt;", "a b'"]
    assert one(spark, clean.clean_text, "<![CDATA[恒指　升]]>", "港股造好。編輯：宋家樑", "跌逾3%。記者：張三", "A &amp; B <b>bold</b>") == ["恒指 升", "港股造好。", "跌逾3%。", "A & B bold"]
    assert one(spark, clean.toneless, "hang4", "7", "aa") == ["hang", "", "aa"]


def test_pack(spark):
    got = one(spark, segment.pack, "今日天氣好。我去行山，你去唔去？", "", None)
    assert "".join(u["text"] for u in got[0]) == "今日天氣好。我去行山，你去唔去？" and all(u["chars"] <= 15 for u in got[0]) and got[1] == [] and got[2] is None
    assert one(spark, segment.sentences, "我很開心。你呢？", "恒生指數今日高開，收市升咗。") == [["我很開心。", "你呢？"], ["恒生指數今日高開，", "收市升咗。"]]


def test_folds_of_any_length(spark):
    """What a fold emits, over arrays shorter and longer than a part."""

    def step(total, x):
        new = total + x
        return new, F.when(x % 3 == 0, F.array(new)).otherwise(F.array().cast("array<bigint>"))

    for n in (0, 1, 63, 64, 65, 5000):
        got = spark.range(1).select(folds.scan(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")) if n else F.array().cast("array<bigint>"), "bigint", F.lit(0).cast("long"), step, lambda t: F.array(-t)).alias("x")).first()["x"]
        assert got == [k * (k + 1) // 2 for k in range(3, n + 1, 3)] + ([-n * (n + 1) // 2] if n else [])
    text = "短句。" * 20000
    got = spark.createDataFrame([(text,)], "t string").select(segment.pack(F.col("t")).alias("u")).first()["u"]
    assert "".join(u["text"] for u in got) == text and {u["chars"] for u in got} == {8}


def test_studyable(spark):
    assert one(spark, chars.is_studyable, "港股", "港股在下半年首個交易日顯著造好恒生指數重返兩萬三千點", "", "Markets rally in New York today on optimism") == [False, True, False, False]
    assert one(spark, chars.script_count, "學習abc很重要。", "𨋢") == [5, 1]
    assert one(spark, chars.is_shown_with_reading, "學", "𨋢", "A") == [True, False, False]
    a, b = one(spark, lambda c: chars.news_score(c, c), "恒指升400點 收市報23232點 升幅1.54% 滬指跌1%", "政府宣布推出新政策 監管機構調查一宗大型收購 涉及通脹及就業")
    assert a < b


def test_measures_in_one_pass(spark):
    """Measures of odd texts, against the builders that count one class each and against the SQL."""
    long = "宣布上市" * 300_000  # longer than the part that is looked up at once
    texts = ["", " ", "港股", "A的", "ࡰ的", "𨋢𠀀🙂a", "百分百分%%9百", "報9報x報恒生恒生指數", "宣宣布布公布收市收入", "洗黑錢\x00\n恒指", long, "的 " + long, "x" + "收市9" * 400_000, "平" * 40]
    for p in (chars.HAN, chars.LATIN):
        m = chars.measures(F.col("t"), p)
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, t string").select("i", "t", F.struct(*[v.alias(k) for k, v in m.items()]).alias("m"))
        own = F.struct(chars.script_count(F.col("t"), p).alias("script"), chars.script_fraction(F.col("t"), p).alias("fraction"), chars.digit_density(F.col("t")).alias("density"), chars.is_studyable(F.col("t"), p).alias("studyable"))
        got = rows.select("i", "m", own.alias("own")).orderBy("i").collect()
        for r, t in zip(got, texts, strict=True):
            if t != "ࡰ的":  # a letter that the JVM may not know yet
                assert [r["m"][k] for k in r["own"].asDict()] == list(r["own"]), t[:20]
            news, report = (sum(1 for _ in re.finditer(w, t)) for w in ("|".join(chars.NEWS_WORDS), "|".join(chars.REPORT_WORDS) + "|報[0-9]"))
            assert r["m"]["score"] == news * 3 - report * 1.5 - (len(re.findall("[0-9]|%|百分", t)) / (len(t) + 1)) * 20, t[:20]
        want = duckdb.sql(f"SELECT {oracles.fraction('t', p)} FROM (SELECT unnest({[t for t in texts if len(t) < 99 and chr(0) not in t]}) AS t)").fetchall()
        assert [r["m"]["fraction"] for r, t in zip(got, texts, strict=True) if len(t) < 99 and chr(0) not in t] == [x for (x,) in want]
    assert one(spark, lambda c: chars.counts(c), None, "") == [None, (0, 0, 0, 0, 0, 0)]
    bad = spark.sql("SELECT cast(unhex('E79A84FF') AS string) AS t").select(chars.counts(F.col("t"))["script"]).first()[0]
    assert bad == 1


def test_han_measures_reads_texts_once(spark):
    """One pass counts all: no regex for each measure, each word list and each use."""
    plan = catalog.QUERIES["han_measures"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython [count(") == 1 and plan.count("count(t#") == 1


@pytest.mark.parametrize("f,c", [("市場認為表現理想", "市場覺得表現理想"), ("該公司增長", "嗰間公司有增長"), ("將進行一次會議", "會開一個會"), ("該公司宣布季度收益增長15%", "呢間公司公布季度收益升咗15%"), ("完全相同的句子。", "完全相同的句子。")])
def test_align(f, c):
    pairs = align.align(f, c)
    assert "".join(p["f"] for p in pairs) == f and "".join(p["c"] for p in pairs) == c
    assert not [p for p in pairs[1:-1] if p["f"] == p["c"] and len(p["f"]) == 1]
    assert align.align("", c) is None


def test_align_sequences():
    """Least-edit paths against the whole matrix by definition."""
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randrange(8))) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        got = align.align_sequences(a, b)
        assert [p["ai"] for p in got if p["ai"] >= 0] == list(range(len(a))) and [p["bj"] for p in got if p["bj"] >= 0] == list(range(len(b)))
        assert sum(not p["match"] for p in got) == d[len(a), len(b)] and all(p["match"] == (p["ai"] >= 0 <= p["bj"] and a[p["ai"]] == b[p["bj"]]) for p in got)


def test_grades(spark):
    got = {r["id"]: (r["accuracy"], r["marks"]) for r in catalog.QUERIES["grade_attempts"](spark, SF).collect()}
    assert got[5] == (1.0, "ok,ok,ok,ok,ok,ok") and got[7] == (1.0, "ok,ok,ok,ok,ok") and got[6] == (0.8333, "ok,ok,bad,ok,ok,ok") and got[8] == (0.5, "soft,bad")
    assert got[4] == (0.0, "") and got[9][0] == got[11][0] == got[12][0] == 1.0 and got[10] == (0.0, "bad,bad")


def test_balanced(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, "b", 5), (4, "b", 5)], "o int, s string, v int")
    assert [r["o"] for r in select.balanced(df, "s", "o", F.col("v"), 3).collect()] == [2, 3, 1]


def test_feeds(spark):
    got = catalog.QUERIES["rss_items"](spark, SF).orderBy("feed_ord", "item_ord").collect()
    assert [(r["feed_ord"], r["title"]) for r in got] == [(0, "港股造好"), (0, "Markets"), (0, "<甲&amp;乙>"), (1, "滬指半日跌近1% 深證成指跌逾2%"), (1, "投資組合公司季度表現回顧")]
    assert got[4]["content"] == "投資組合公司本季度收入增長百分之十五， 表現 理想。\n\n管理層認為未來需求持續， 計劃擴充產能。" and got[2]["published"].startswith("Thu")
    assert catalog.QUERIES["fetched_articles"](spark, SF).count() == 2
    assert [r["title"] for r in catalog.QUERIES["custom_feed"](spark, SF).where("feed_ord = 1").orderBy("item_ord").collect()] == ["滬指半日跌近1% 深證成指跌逾2%", "投資組合公司季度表現回顧"]
    assert feeds.landed(feeds.catalogue(spark), spark.createDataFrame([], "url string, xml string")).count() == 0


def test_search(spark):
    got = catalog.QUERIES["search_articles"](spark, SF).orderBy("ord").collect()
    assert [(r["ord"], r["url"]) for r in got] == [(0, "https://publisher.example/story1"), (2, "https://other.example/story2")] and got[0]["title"] == "貝恩資本提出收購要約，交易升溫"
    assert one(spark, search.wrapped_id, "https://x/articles/CBM?oc=5", "https://x") == ["CBM", ""]


def test_tiers(spark):
    got = {(r["article_id"], r["unit_id"]): (r["colloquial"], r["pairs"], r["verified"], r["repaired"]) for r in catalog.QUERIES["tier1_rewrites"](spark, SF).collect()}
    assert got == {
        ("a0", 0): ("個市造好。", "市場造好。>個市造好。", True, False), ("a0", 1): ("供應不足。", "供應不足。>供應不足。", True, True), ("a0", 2): ("嗰間公司2020年升咗15%。", "該>嗰間|公司2020年>公司2020年|增長15%。>升咗15%。", True, False),
        ("a1", 0): ("他們現在了解。", None, False, False), ("a1", 1): ("佢話冇。", None, False, False),
    }
    two = {(r["article_id"], r["unit_id"]): r["colloquial"] for r in catalog.QUERIES["tier2_rewrites"](spark, SF).collect()}
    assert two == {("a0", 0): "個市好好。", ("a0", 1): "供應不足。", ("a0", 2): "該公司2020年增長15%。", ("a1", 0): "佢哋而家了解。", ("a1", 1): "佢話冇。", ("a3", 0): "沒有人說話了。"}


def test_chats(spark):
    got = {(r["model"], r["call_ord"]): (r["content"], r["status"], r["tried"], r["waited_ms"], r["skipped"]) for r in catalog.QUERIES["chat_outcomes"](spark, SF).collect()}
    assert got["big", 0] == ("a", 200, 2, 15000, False) and got["big", 1] == ("b", 200, 4, 7000 + 30000 + 120000, False) and got["big", 2] == (None, 401, 1, 0, False)
    assert got["big", 3] == (None, 429, 1, 0, False) and got["big", 4] == got["small", 1] == (None, None, 0, 0, True)
    assert got["small", 0] == (None, 429, 3, 45000, False) and got["mini", 0] == (None, 500, 4, 90000, False) and got["mini", 1][0] == "c" and got["mini", 2] == (None, None, 1, 15000, False)


def test_requests(spark):
    rows = {(r["article_id"], r["batch_id"]): r for r in rewriting.requests(catalog._units(spark), rewriting.PLAIN_REWRITE, 2).collect()}
    assert rows["a0", 0]["user"].endswith("\n\n1. 市場造好。\n2. 供應不足。") and "exactly 2 items" in rows["a0", 0]["user"] and rows["a0", 1]["n"] == 1
    review = rewriting.requests(catalog._units(spark).withColumn("colloquial", F.lit("x")), rewriting.REVIEW, 2).where("article_id = 'a1'").first()["user"]
    assert review.endswith("1.\nWRITTEN: 他們現在了解。\nCANTONESE: x\n\n2.\nWRITTEN: 他說沒有。\nCANTONESE: x")


def test_lessons(spark, tmp_path):
    one_set = catalog._set(spark)
    assert files.write_lessons(one_set, str(tmp_path / "set")) and not files.write_lessons(one_set.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    back = files.read_lessons(spark, str(tmp_path / "set"), str(tmp_path / "absent")).first()
    assert (back["date"], back["source"], back["method"]) == ("2026-07-01", "甲 + 乙", "llm+verify") and [a["id"] for a in back["articles"]] == ["a0", "a1", "a2", "a3"]
    a0 = back["articles"][0]
    assert (a0["method"], a0["verified"], a0["repaired"], a0["converted"]) == ("llm+verify", True, 1, True) and [s["id"] for s in a0["sentences"]] == [0, 1, 2]
    assert a0["sentences"][2]["colloquial"] == "嗰間公司二零二零年升咗百分之十五。" and a0["sentences"][1]["pairs"] is None
    for a in back["articles"]:
        for s in a["sentences"]:
            assert len(s["jyutping"]) == len(s["colloquial"]) and (s["pairs"] is None or ("".join(p["f"] for p in s["pairs"]) == s["formal"] and "".join(p["c"] for p in s["pairs"]) == s["colloquial"]))
    failed = quality.failures(spark.createDataFrame([(1, "")], "id int, x string"), "id", {"x": F.col("x") != ""})
    assert not files.write_curriculum(catalog._curriculum(spark), failed, str(tmp_path / "c")) and files.write_curriculum(catalog._curriculum(spark), failed.limit(0), str(tmp_path / "c"))
    assert len(files.read_curriculum(spark, str(tmp_path / "c")).first()["categories"]) == 3 and files.read_curriculum(spark, str(tmp_path / "no")).count() == 0


def test_missing_lessons_are_reported(spark):
    none = spark.createDataFrame([], files.LESSONS)
    assert [tuple(r) for r in quality.lesson_failures(none, "daily").collect()] == [("daily", "missing")]
    assert [r["rule"] for r in quality.conversation_failures(spark.createDataFrame([], files.CURRICULUM)).collect()] == ["missing"]


def test_config():
    cfg = EngineConfig.of({"TIER2_MODEL": "m", "TIER2_FALLBACK_MODEL": "m", "BUILD_DATE": "d"}, query="q")
    assert cfg.tier2.models == ("m",) and cfg.tier2.batch == 20 and cfg.date == "d" and cfg.searches
    assert not EngineConfig.of({"SECONDARY_QUERY": "off"}).searches and not EngineConfig.of({"SECONDARY_FEED_URL": "u"}, query="q").searches


def test_listening(spark):
    got = {r["session_id"]: (round(r["stop"] - r["start"], 3), r["reason"], r["transcript"]) for r in catalog.QUERIES["speech_listen"](spark, SF).collect()}
    assert got == {
        "a": (8.5, "silence", "市場造好"), "b": (8.0, "no word", ""), "c": (5.0, "fatal", "好"), "d": (45.0, "longest", "字" * 45), "e": (0.5, "stopped", "一二"), "f": (3.5, "silence", "起"), "g": (9.5, "silence", "開完"),
    }
    worn = [("w", t / 10, t, "end" if t % 2 else "result", "a" if not t % 2 else None, None, None) for t in range(200)]
    h, over = speech.Hearing(None), None
    for _, t, _, kind, final, interim, error in worn:
        over = over or h.take(t, kind, final, interim, error)
    assert over == (12.3, "restarts")
    rows = spark.createDataFrame(worn, "session_id string, t double, ord int, kind string, final string, interim string, error string").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r["reason"], r["transcript"]) for r in speech.listen(rows).collect()] == [("restarts", h.transcript())]


def test_hearing_as_a_stream(spark, tmp_path):
    """The stream gives what the batch gives, for events that come in order."""
    begin = 1_000_000
    rows = catalog.speech_events(spark).withColumn("ts", F.timestamp_seconds(F.col("ts").cast("double") + begin))
    rows.unionByName(rows.limit(1).selectExpr("'late' AS session_id", "ord", "kind", "final", "interim", "error", f"timestamp_seconds({2 * begin}) AS ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream = speech.listen_stream(events, "1 second").writeStream.format("memory").queryName("heard").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    got = {r["session_id"]: (round(r["stop"] - begin, 3), r["reason"], r["transcript"]) for r in spark.table("heard").collect()}
    want = {r["session_id"]: (r["stop"], r["reason"], r["transcript"]) for r in catalog.QUERIES["speech_listen"](spark, SF).collect()}
    assert got == want


def test_dialogue(spark):
    assert one(spark, lambda c: dialogue.audio_name(c, F.lit(dialogue.NEWS_VOICE)), "恒生指數今日高開，收市升咗超過百分之二。") == ["609345a219027e4d.mp3"]
    assert [r["score"] for r in catalog.QUERIES["voice_scores"](spark, SF).orderBy("id").collect()] == [-1, 1, 6, 5, 5, 5, 4, -1]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_match_their_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLE[name])
    cols = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(str(plain(v)) for _, v in sorted(zip(cols, r, strict=True))) for r in found.fetchall())
    assert sorted(tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect()) == want

"""Small inputs in the reference formats; the driver's tables hold no Han text."""

from __future__ import annotations

HAN_TEXTS = [
    (1, "港股在下半年首個交易日顯著造好恒生指數重返兩萬三千點"), (2, "政府宣布推出新的監管政策，調查三間公司違規。"), (3, "恒指收市報25000點，升幅1.5%。"),
    (4, "他們現在了解這個目的。"), (5, "Markets rally in New York"), (6, ""), (7, "公司2020年收入10500萬，增長15%。"), (8, "他說「他們的目的」是和平了，他走了"),
    (9, "由1997年至2003年，他們和我們沒有見過15個人了。其他人說明了！"), (10, "學習abc很重要。𨋢門開了？"), (11, " 　今日 天 氣 好。 \n 明日呢？ "),
]
JUNK_ROWS = [
    (1, "網頁已經閒置了一段時間，請重新載入頁面"), (2, "使用Cookies以改善體驗"), (3, "政府今日公布新措施。"), (4, "版權所有，不得轉載"), (5, " "), (6, "相關新聞："),
    (7, "《經濟通》所刊的署名及/或不署名文章，相關內容屬作者個人意見，並不代表《經濟通》立場。"), (8, "請先登入或成為會員，即可閱讀全文。"), (9, "立即訂閱我們的電子報，緊貼市場動態。"),
    (10, "請啟用JavaScript以獲得最佳瀏覽體驗。"), (11, "恒生指數今日收市升200點，成交額增加。"), (12, "ALL RIGHTS RESERVED 2020"), (13, "a plain paragraph on cookieless tracking"), (14, "相關文章一覽"),
]
TITLES = [
    (1, "公司簽署備忘錄 | 主頁 - 新聞"), (2, "世界盃｜決賽今晚舉行"), (3, "樓市回暖 - 某報"), (4, "要點 ｜ 首頁 | 新聞"), (5, "貝恩資本收購案升溫 - Yahoo 財經"), (6, "無來源後綴"), (7, " - "), (8, "a-b - c - d"), (9, "新聞"),
]
NUMBERS = ["0", "7", "10", "13", "30", "105", "110", "400", "1005", "2020", "10000", "10500", "25000", "12345", "100000000", "250060000", "00012", "12345678901234567", "1000000000000", "9999999999999999", "10010", "100010001000"]
ATTEMPTS = [
    (1, "我是學生", "我係學生"), (2, "他有10蚊", "佢有十蚊"), (3, "市場理想", "市長"), (4, "", "好"), (5, "呢間公司升咗。", "這間公司升了"), (6, "我今日好開心", "我今好開心"), (7, "佢話係我嘅", "他說是我的"),
    (8, "詩書", "試公"), (9, "二零二零年經濟好", "2020年經濟好"), (10, "升咗！", ""), (11, "賣出五百個", "賣出500個"), (12, "學習", "学习"),
]
READINGS = [("場", ["coeng"]), ("長", ["coeng", "zoeng"]), ("詩", ["si"]), ("試", ["si"]), ("書", ["syu"]), ("公", ["gung"])]
SCRIPT = ("學習國", "学习国")
SPELL = [
    (1, "2020年", ""), (2, "1997年香港回歸", ""), (3, "賣出2020個", ""), (4, "5年計劃", ""), (5, "30年", ""), (6, "7月3日", ""), (7, "12月25號", ""), (8, "升15%", ""), (9, "跌3.5%", ""), (10, "指數報3.75", ""),
    (11, "1,234人", ""), (12, "恒指報25,000點", ""), (13, "2020至2021年", ""), (14, "2020至21年", ""), (15, "熱線28463222", ""), (16, "到2020", "年底"), (17, "賣出500", "個"), (18, "恒生指數今日高開。", ""),
    (19, "（TYO:9433）", ""), (20, "編號：2046", ""), (21, "賣出9433個", ""), (22, "每股3，384日圓", ""), (23, "2020—21年", ""), (24, "2020年至21年", ""), (25, "2846 3222", ""), (26, "2020至 2021年", ""), (27, "2020至 2021 年", ""),
    (28, "500,買", ""), (29, "2020,年", ""), (30, "10:30", ""), (31, "202 至 5 年", ""), (32, "2020　年", ""), (33, "共2020", "年"), (34, "1.5至2.5%", ""), (35, "2020~21", "年"), (36, "報３．５升１５％", ""), (37, "2020至2021", "年"),
]
XML = [
    (0, "甲", "<rss><item><title>港股造好</title><link>http://a.hk/1</link><description><![CDATA[恒生指數在下半年首個交易日顯著造好，重返兩萬三千點水平。 編輯：陳]]></description></item><item><title>Markets</title><link>http://a.hk/2</link><description>Markets rally</description></item><item><titleX a='1'>&lt;甲&amp;amp;乙&gt;</title><link></link><description>政府宣布推出新的監管政策，調查三間公司違規，並會公布結果。</description><pubDate>Thu, 02 Jul 2026 10:02:35 +0800</pubDate></item></rss>"),
    (1, "乙", "<rss><ITEM><title><![CDATA[滬指半日跌近1%　深證成指跌逾2%]]></title><link>http://a.hk/1</link><description>恒生指數在下半年首個交易日顯著造好，重返兩萬三千點水平。</description></ITEM><item><title>投資組合公司季度表現回顧</title><link>http://b.hk/9</link><description>短摘要。</description><content:encoded><![CDATA[<p>投資組合公司本季度收入增長百分之十五，<b>表現</b>理想。</p><p>管理層認為未來需求持續，<br/>計劃擴充產能。</p>]]></content:encoded></item></rss>"),
    (2, "丙", None),
]
STORY = '<html><body><div class="itemFullText">港股顯著造好，恒生指數重返23000點以上。<br><br>\n金融及科技股推高大市，美團升近6%，成交額超過一千億元，投資者情緒明顯改善。<br><br>\n編輯：宋家樑</div></body></html>'
PAGES = [
    (1, "<p>跳至導覽 跳過主要內容 雅虎香港財經 新聞 財經 體育 更多</p><p>貝恩資本今日宣布，以每股三千七百日圓提出收購要約，較市價有溢價。</p><p><b>管理層表示</b>，交易完成後將維持現有品牌，並繼續投資技術平台。</p><p>This is an English-only paragraph that should be dropped entirely.</p><p>版權所有 不得轉載</p>"),
    (2, "<p>跳至導覽 跳過主要內容 新聞 財經 體育 更多 港聞 娛樂圈 電影 國際 專欄 天氣，登入 電郵。</p><p>該銀行預計南韓和台灣到 2027 年將展現最強勁的獲利成長，主要受惠於記憶體價格上升。</p>"),
    (3, "<script>var a = '<p>不是文章的內容，但是有十二個字以上的段落。</p>';</script><p>本網站由某某集團有限公司營運總部設於香港中環, Tel: 1234</p><pre>代碼，</pre><p>開頭不完整的段落，但是後面有足夠的文字可以保留下來。</p>"),
    (4, None), (5, ""), (6, "<p>" + "長段落的文字，" * 130 + "</p><p>" + "第二個段落的文字，" * 100 + "</p><p>第三個段落不會保留，因為長度已經超過了。</p>"),
]
WRAPPED = [
    ("https://news.example/rss/articles/CBMiTEST?oc=5", '<c-wiz data-n-a-ts="1783141222" data-n-a-sg="AVvZt1Etest"></c-wiz>', ')]}\'\n\n[["wrb.fr","Fbv4je","[\\"garturlres\\",\\"https:\\/\\/publisher.example\\/story1\\"]",null]]'),
    ("https://news.example/rss/articles/CBMiDUP?oc=5", '<c-wiz data-n-a-ts="1" data-n-a-sg="b"></c-wiz>', '["garturlres","https://other.example/story2"]'),
    ("https://news.example/rss/articles/CBMiNO", '<c-wiz data-n-a-ts="1"></c-wiz>', '["garturlres","https://third.example/x"]'), ("https://not-a-wrapper.example/x", "", None), ("https://news.example/rss/articles/CBMiD", '<c-wiz data-n-a-ts="1" data-n-a-sg="b"></c-wiz>', "nothing"),
]
SEARCH_XML = "<rss>" + "".join(
    f"<item><title>{t}</title><link>{u}</link><description>s</description><pubDate>Thu, 02 Jul 2026 0{i}:00:00 GMT</pubDate></item>"
    for i, (t, u) in enumerate([("貝恩資本提出收購要約，交易升溫 - Yahoo 財經", WRAPPED[0][0]), ("貝恩資本提出收購要約，交易升溫 - 香港01", WRAPPED[1][0]), ("另一篇報道 - 某報", WRAPPED[1][0]), ("沒有連結", WRAPPED[4][0]), (" - 只有來源", WRAPPED[1][0])])
) + "</rss>"
SEARCH_PAGES = [
    ("https://publisher.example/story1", "<p>貝恩資本今日宣布，以每股三千七百日圓提出收購要約，較市價有明顯溢價，交易總值約六千億日圓。</p><p>管理層表示，交易完成之後將維持現有品牌，並繼續投資技術平台，擴展亞太區業務，創造長遠價值。</p>"),
    ("https://other.example/story2", "<p>另一間公司今日宣布，將會收購一間從事物流的公司，交易總值約三億元，預計於年底之前完成有關交易。</p><p>管理層表示，完成之後將會繼續投資，並且擴展業務至東南亞各地，創造更多就業機會，以及更好的服務。</p>"),
]
VOICES = [(1, "en-US", "Samantha"), (2, "zh-CN", "Tingting"), (3, "zh_HK", "Sinji"), (4, "zh-HK", "Google"), (5, "yue-HK", "x"), (6, "fr", "Cantonese voice"), (7, "en-HK", "y"), (8, None, None)]
LABELS = [("lines", "en", "lines"), ("lines", "hant", "句"), ("sentenceOf", "en", "Sentence {0} of {1}"), ("sentenceOf", "hant", "第 {0} 句，共 {1} 句"), ("only", "en", "only English")]
SPEAKERS = [(1, "阿明"), (2, '{"en":"Ming","hant":"明","hans":"明明"}'), (3, '{"hant":"陳"}'), (4, '{"en":"Chan"}'), (5, None)]
REPLIES = [(1, '```json\n{"sentences": ["個市造好。"]}\n```'), (2, 'Sure: {"sentences": ["a", "b"]} done'), (3, "no json"), (4, '{"sentences": ["a"'), (5, "[1, 2]"), (6, None), (7, '{"other": 1}'), (8, "```\n{}\n```")]

# Articles' units, and the landed replies of both tiers: (article, batch, model, content, refused).
UNITS = [("a0", 0, "市場造好。"), ("a0", 1, "供應不足。"), ("a0", 2, "該公司2020年增長15%。"), ("a1", 0, "他們現在了解。"), ("a1", 1, "他說沒有。"), ("a2", 0, "第一句。"), ("a3", 0, "沒有人說話了。")]
REWRITTEN = [
    ("a0", 0, "m", '{"sentences":[{"colloquial":"個市造好。","pairs":[{"f":"市場造好。","c":"個市造好。"}]},{"colloquial":"供應唔足。","pairs":[{"f":"亂","c":"來"}]}]}', False),
    ("a0", 1, "m", '{"sentences":[{"colloquial":" 嗰間公司２０２０年升咗１５％。 ","pairs":[{"f":"該","c":"嗰間"},{"f":"","c":""},{"f":"公司2020年","c":"公司２０２０年"},{"f":"增長15%。","c":"升咗１５％。"}]}]}', False),
    ("a1", 0, "m", '{"sentences":[{"colloquial":"","pairs":[]},{"colloquial":"佢話冇。","pairs":null}]}', False), ("a2", 0, "m", '{"sentences":[]}', False), ("a3", 0, "m", '{"sentences":[{"colloquial":"x","pairs":[]}]}', True),
]
VERDICTS = [
    ("a0", 0, "m", '{"verdicts":[{"ok":true,"fixed":null,"fixed_pairs":null},{"ok":false,"fixed":"供應不足。","fixed_pairs":[{"f":"供應不足。","c":"供應不足。"}]}]}', False),
    ("a0", 1, "m", '{"verdicts":[{"ok":false,"fixed":" ","fixed_pairs":null}]}', False), ("a1", 0, "m", None, False),
]
PLAIN_REPLIES = [
    ("a0", 0, "big", '{"sentences":["一"]}', False), ("a0", 0, "small", '{"sentences":["個市造好。","供應不足。"]}', False), ("a0", 1, "small", '{"sentences":["嗰間公司升咗。"]}', False), ("a0", 1, "big", '{"sentences":["該公司2020年增長１５％。"]}', False),
    ("a1", 0, "big", '{"sentences":["佢哋而家了解。","佢話冇。"]}', False), ("a2", 0, "other", '{"sentences":["x"]}', False), ("a3", 0, "big", '```json\n{"sentences":[""]}\n```', False),
]
REVIEWS = [("a0", 0, "small", '{"sentences":["個市好好。",""]}', False), ("a1", 0, "small", '{"sentences":["只有一句"]}', False), ("a3", 0, "small", None, False)]
CHAT = [  # model, call, attempt, status, retry-after, content
    ("big", 0, 0, 429, None, None), ("big", 0, 1, 200, None, "a"), ("big", 1, 0, 500, 7, None), ("big", 1, 1, 503, None, None), ("big", 1, 2, 429, 200, None), ("big", 1, 3, 200, None, "b"), ("big", 2, 0, 401, None, "x"), ("big", 3, 0, 429, 86400, None),
    ("big", 3, 1, 200, None, "late"), ("big", 4, 0, 200, None, "skipped"), ("small", 0, 0, 429, None, None), ("small", 0, 1, 429, None, None), ("small", 0, 2, 429, 1000, None), ("small", 1, 0, 200, None, "skipped"), ("mini", 0, 0, 500, None, None), ("mini", 0, 1, 500, None, None),
    ("mini", 0, 2, 500, None, None), ("mini", 0, 3, 500, None, None), ("mini", 1, 0, 200, None, "c"), ("mini", 2, 0, 429, None, None),
]
SPEECH = [  # session, seconds, order, kind, finals, interim, error
    *[("a", t, i, k, f, m, e) for i, (t, k, f, m, e) in enumerate([(0.0, "start", None, None, None), (1.0, "result", "", "市", None), (2.0, "result", "市場", "", None), (2.5, "end", None, None, None), (5.0, "result", "", "造好", None), (9.0, "result", "晚了", "", None)])],
    *[("b", t, i, k, f, m, e) for i, (t, k, f, m, e) in enumerate([(10.0, "start", None, None, None), (12.0, "result", " ", "", None), (18.5, "result", "遲", "", None)])],
    *[("c", t, i, k, f, m, e) for i, (t, k, f, m, e) in enumerate([(0.0, "start", None, None, None), (3.0, "result", "好", "", None), (4.0, "error", None, None, "network"), (5.0, "error", None, None, "not-allowed"), (6.0, "result", "好好", "", None)])],
    *[("d", float(t), t, "result", "字" * t, "", None) for t in range(0, 60, 3)],
    *[("e", t, i, k, f, m, e) for i, (t, k, f, m, e) in enumerate([(1.5, "result", "一", "二", None), (2.0, "stop", None, None, None), (2.1, "result", "三", "", None)])],
    *[("f", t / 10, t, "end" if t else "result", "起" if not t else None, "頭" if not t else None, None) for t in range(0, 70)],
    *[("g", t, i, k, f, m, e) for i, (t, k, f, m, e) in enumerate([(0.0, "result", "開", "始", None), (1.0, "end", None, None, None), (3.0, "result", "", "", None), (6.0, "result", "完", "", None)])],
]
_T = lambda en, hant="題", hans="题": {"en": en, "hant": hant, "hans": hans}
CURRICULUM = {
    "categories": [
        {
            "id": "food", "emoji": "", "title": _T("Food"),
            "scenarios": [
                {"id": f"s{k}", "level": k % 4, "emoji": "🍜" if k % 2 else None, "title": _T(f"Scene {k}") if k != 3 else {"en": None, "hant": "三", "hans": "三"}, "lines": [{"speaker": "甲" if j % 2 else '{"en":"B","hant":"乙"}', "formal": f"他們來{'了' * j}", "colloquial": "" if (k, j) == (5, 1) else "佢哋嚟", "en": "x" if j else None} for j in range(k % 4)]}
                for k in range(12)
            ],
        },
        {"id": "few", "emoji": "🎒", "title": {"en": "Few", "hant": None, "hans": "少"}, "scenarios": [{"id": "t0", "title": _T("T"), "lines": [{"speaker": None, "formal": "佢來3次", "colloquial": "佢嚟3次", "en": ""}]}]},
        {"id": None, "title": _T("No id"), "scenarios": None},
    ]
}
RULES = [("他", "佢", "char"), ("他們", "佢哋", "phrase"), ("其他", None, "protect"), ("了解", "明白", "phrase"), ("了解", None, "protect"), ("目的", "目標", "phrase"), ("目的", "旨", "char"), ("", "x", "char"), ("港股", "", "phrase"), ("公司", "間公司", "phrase")]
#: A source that passes every check.
GOOD_SOURCE = {"categories": [{"id": f"c{c}", "emoji": None, "title": _T(f"C{c}"), "scenarios": [{"id": f"c{c}s{k}", "title": _T(f"S{k}"), "lines": [{"speaker": "甲", "formal": "他們來", "colloquial": "佢哋嚟", "en": None}] * (1 + (k + c) % 3)} for k in range(12)]} for c in range(2)]}
CANDIDATES = [  # ord, title, body, url, published, source
    *[(k, f"題目{k}", "政府宣布推出新政策，" * (1 + k % 9), f"http://p/{k}", None, f"來源{k % 3}") for k in range(20)], (20, "恒指", "恒指收市報25000點，升幅1.5%。" * 6, "http://p/20", None, "來源3"),
    (21, "雜", "版權所有，不得轉載\n\n" + "銀行調查就業及通脹，" * 10, "http://p/21", None, "來源3"),
]
SECONDARY = [(0, "次要一", "貝恩資本今日宣布提出收購要約，較市價有明顯的溢價，交易總值約六千億，預計年底完成有關交易，管理層表示歡迎。", "http://s/0", None, "次要"), (1, "太短", "很短。", "http://s/1", None, "次要")]
READING_ROWS = [("市", 0, "si5"), ("場", 0, "coeng4"), ("行", 1, "hong4"), ("行", 0, "hang4"), ("行", 2, "hang6"), ("行", 3, "haang4"), ("A", 0, "ei1"), ("𨋢", 0, "lip1"), ("㐀", 0, "jau1"), ("空", 0, "7"), ("好", 0, "hou2"), ("好", 1, "hou3")]
SPOKEN_READINGS = {"市": "si5", "場": "coeng4", "造": "zou6", "好": "hou2", "個": "go3", "佢": "keoi5", "話": "waa6"}
QUALITY = [
    (1, "他好", "佢好", ["keoi5", "hou2"], [("他", "佢"), ("好", "好")]), (2, "", "佢", ["keoi5"], None), (3, "他", "佢", [], [("他", "你")]), (4, "他。", "佢。", ["keoi5", ""], []), (5, "他", "佢", [""], None), (6, "a", "a", ["x"], None), (7, None, "佢", ["keoi5"], None), (8, "他", "佢", None, None),
]

#: Latin letters and marks as Han ones, by which the driver's tables run the Han rules at volume; blanks go.
HAN_FROM = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ".,;:!?"
HAN_TO = "的是他們我你這那沒有現在說和認為目了解否其平明年至到" * 2 + "。，；：！？"

"""Text cleaning and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import CJK, HAN, SPACE, ScriptProfile, script_count, squeeze, trim
from .folds import let, scan

# Fixed values, in their order: entities and their text; the ampersand goes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# Patterns of boilerplate paragraphs.
JUNK = [
    r"網頁.{0,6}閒置|閒置(?:了|咗)?一段時間",
    r"重新載入|重新整理|立即載入|請刷新",
    r"網頁已過期|頁面已過期|載入頁面",
    r"(?i)請啟用\s*JavaScript|不支援.{0,6}瀏覽器|升級.{0,6}瀏覽器",
    r"署名(?:及|或|及/或).{0,8}文章|不署名文章",
    r"作者個人意見|並不代表.{0,12}(?:立場|觀點)|不代表本(?:網|台|報)",
    r"(?i)免責聲明|使用條款|私隱政策|隱私政策|版權所有|不得轉載|All rights reserved",
    r"(?i)(?<![A-Za-z0-9_])cookies?(?![A-Za-z0-9_])|Cookie政策",
    r"請先登入|登入後(?:繼續|閱讀)|成為會員|全文只供|訂戶專享",
    r"立即訂閱|訂閱.{0,8}(?:電子報|通訊|頻道)|訂閱我們",
    r"廣告查詢|聯絡我們|返回(?:主頁|首頁)|相關(?:文章|新聞)[:：]?\z",
]
NAV = "主頁|首頁|新聞|即時新聞|財經新聞|要聞|Home"


def decode_entities(c: Column) -> Column:
    for name, text in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


def _no_cdata(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")


def _no_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def clean_text(c: Column) -> Column:
    """CDATA, tags, entities and the editor's credit gone, blanks squeezed."""
    c = decode_entities(_no_tags(_no_cdata(c)))
    c = F.regexp_replace(c, r"[\x{3000}\x{00A0}]", " ")
    return squeeze(F.regexp_replace(c, rf"(?s)[{SPACE}]*(?:編輯|記者)[{SPACE}]*[:：].*\z", ""))


def _paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\n{2,}"), lambda p: squeeze(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def clean_html_body(c: Column) -> Column:
    c = F.regexp_replace(_no_cdata(c), r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|li|h[1-6]|section)>", "\n\n")
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return _paragraphs(decode_entities(_no_tags(c)))


def container_body(c: Column, css_class: str = "itemFullText") -> Column:
    """The text of the first element of that class up to its first closing div, without credits."""
    inner = F.regexp_extract(c, rf'(?is)class="{css_class}"[^>]*>(.*?)</div>', 1)
    inner = F.regexp_replace(F.regexp_replace(inner, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|li)>", "\n")
    inner = decode_entities(_no_tags(inner))
    return _paragraphs(F.regexp_replace(inner, r"(?s)\s*(?:編輯|記者)\s*[:：].*\z", ""))


# What every boilerplate paragraph holds: a character beyond Latin, or one of the Latin words.
_MAYBE_JUNK = r"[\x{2E80}-\x{10FFFF}]|(?i:cookie|all rights reserved)"
_JUNK = "|".join(f"(?:{j})" for j in JUNK)


def is_junk(p: Column) -> Column:
    return let(trim(p), lambda t: (t == "") | (F.rlike(t, F.lit(_MAYBE_JUNK)) & F.rlike(t, F.lit(_JUNK))))


def item_body(description: Column) -> Column:
    """The text of a feed item: its description, without the title."""
    return trim(F.coalesce(description, F.lit("")))


def strip_junk(body: Column) -> Column:
    return F.array_join(F.filter(F.split(body, r"\n{2,}"), lambda p: ~is_junk(p)), "\n\n")


def clean_title(c: Column) -> Column:
    c = trim(F.regexp_replace(c, rf"[{SPACE}]+-[{SPACE}]+[^-]+\z", ""))
    return trim(F.regexp_replace(c, rf"(?:[{SPACE}]*[|｜][{SPACE}]*(?:{NAV})[{SPACE}]*)+\z", ""))


def script_gaps(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?<=[{CJK}]) (?=[{CJK}])"))


def page_paragraphs(html: Column) -> Column:
    """``array<string>`` of the texts of all paragraph elements, in order."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: squeeze(decode_entities(_no_tags(p))))


def utf16_length(c: Column) -> Column:
    """Length in the units of the source format, two for a character beyond the basic plane."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))


def article_paragraphs(html: Column, p: ScriptProfile = HAN, min_chars: int = 12, max_chars: int = 1600) -> Column:
    """``array<string>`` of prose paragraphs, up to the one whose length takes their sum past ``max_chars``."""

    def measured(x: Column) -> Column:
        return F.struct(x.alias("x"), script_count(x, p).alias("n"), utf16_length(x).alias("u"))

    def is_prose(m: Column) -> Column:
        return (m["n"] >= min_chars) & (m["n"] >= m["u"] * 0.4) & F.rlike(m["x"], F.lit(f"[{p.prose}]")) & (script_gaps(m["x"]) < 3) & ~is_junk(m["x"])

    def step(seen: Column, m: Column) -> tuple[Column, Column]:
        none = F.array().cast("array<string>")
        return F.when(seen > max_chars, seen).otherwise(seen + m["u"]), F.when(seen > max_chars, none).otherwise(F.array(m["x"]))

    prose = F.filter(F.transform(page_paragraphs(html), measured), is_prose)
    return scan(prose, "string", F.lit(0), step)


def article_body(html: Column, p: ScriptProfile = HAN, min_chars: int = 12, max_chars: int = 1600) -> Column:
    """The paragraphs joined by blank lines."""
    return F.array_join(article_paragraphs(html, p, min_chars, max_chars), "\n\n")


def normalize_digits(c: Column) -> Column:
    c = F.translate(c, "０１２３４５６７８９", "0123456789")
    c = F.regexp_replace(c, "(?<=[0-9])，(?=[0-9])", ",")
    return F.regexp_replace(F.regexp_replace(c, "(?<=[0-9])．(?=[0-9])", "."), "(?<=[0-9])％", "%")


def toneless(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+\z", "")


def strict_json(c: Column) -> Column:
    """The text of a reply's JSON: inside its fence if it has one, from the first to the last brace."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    inside = F.when(F.rlike(c, F.lit(r"(?is)```(?:json)?\s*.*?\s*```")), fenced).otherwise(c)
    found = F.regexp_extract(inside, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(trim(inside))


def parse_reply(c: Column, schema: str) -> Column:
    """The reply as a struct of ``schema``, null where it is no JSON object."""
    text = strict_json(c)
    return F.when(F.try_parse_json(text).isNotNull() & F.startswith(text, F.lit("{")), F.from_json(text, schema))


def hostname(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def fuller(a: Column, b: Column, p: ScriptProfile = HAN) -> Column:
    """``b`` where it has strictly more of the script than ``a``."""
    return F.when(script_count(F.coalesce(b, F.lit("")), p) > script_count(F.coalesce(a, F.lit("")), p), b).otherwise(a)

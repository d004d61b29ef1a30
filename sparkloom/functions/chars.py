"""Character measures and predicates.  Classes are explicit, as engines differ on ``\\s`` and ``\\b``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ideograph blocks and the white space of the source format.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}\x{2F800}-\x{2FA1F}\x{30000}-\x{3134A}"
SPACE = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Ticker words and news words of the score.
REPORT_WORDS = "恒指 恒生指數 國指 滬指 深證 創業板 道指 期指 納指 標普 日經 收市 半日 初段 午市 升幅 跌幅 個百分點 成交額 成交金額".split()
NEWS_WORDS = (
    "宣布 公布 收購 併購 合併 監管 政策 裁員 上市 招股 加息 減息 降準 降息 調查 破產 融資 罷工 制裁 關稅 協議 簽署 推出 計劃 預算 失業 通脹 通縮 央行 議息 "
    "訴訟 罰款 停牌 派息 盈利 虧損 重組 入股 擴張 發布 合作 禁令 審批 牌照 違規 欺詐 洗黑錢 需求 供應 樓市 地產 收入 業績 預測 警告 風險 就業 貿易"
).split()


@dataclass(frozen=True)
class ScriptProfile:
    """What counts as a letter of the studied script, and how its sentences and paragraphs end."""

    letters: str
    breakers: str
    paragraph: str
    prose: str  # punctuation that tells prose from menus
    min_chars: int = 20
    min_fraction: float = 0.5


# Sentence breakers and prose punctuation of the source format.
HAN = ScriptProfile(CJK, "。！？；…!?;，、：,:", r"\n{2,}|\r\n\r\n", "。！？，；：")
LATIN = ScriptProfile(r"\p{L}", ".!?;:,", r"\n", ".!?;:,")
# The ideographs that are shown with a reading (no supplementary planes).
SHOWN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def count_class(c: Column, chars: str) -> Column:
    """Characters of a class, counted by what is left without them: nothing is built for each one."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def count_text(c: Column, text: str) -> Column:
    """Occurrences of a text that does not overlap itself."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("int")


def script_count(c: Column, p: ScriptProfile = HAN) -> Column:
    return count_class(c, p.letters)


def script_fraction(c: Column, p: ScriptProfile = HAN) -> Column:
    letters = script_count(c, p) if p.letters == r"\p{L}" else count_class(c, rf"\p{{L}}{p.letters}")
    return F.when(letters > 0, script_count(c, p) / letters).otherwise(0.0)


def is_studyable(c: Column, p: ScriptProfile = HAN, min_chars: int | None = None) -> Column:
    return (script_fraction(c, p) >= p.min_fraction) & (script_count(c, p) >= (p.min_chars if min_chars is None else min_chars))


def only_script(c: Column, p: ScriptProfile = HAN) -> Column:
    return F.regexp_replace(c, f"[^{p.letters}]", "")


def digit_density(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, (count_class(c, "0-9") + count_text(c, "%") + count_text(c, "百分")) / n).otherwise(0.0)


def has_digits(c: Column) -> Column:
    return F.rlike(c, F.lit("[0-9]"))


def is_shown_with_reading(c: Column) -> Column:
    """Whether a character is one of those that get a reading above them."""
    return F.rlike(c, F.lit(f"[{SHOWN}]"))


@cache
def _ranges(chars: str) -> list[tuple[int, int]]:
    """Code points of a class like those above, with ``\\p{L}`` as of Unicode 15.0, which the SQL has."""
    out = []
    for one, lo, hi, single in re.findall(r"(\\p\{L\})|\\x\{(\w+)\}-\\x\{(\w+)\}|(.)", chars):
        if single:
            raise ValueError(f"not a class of ranges: {chars}")
        if not one:
            out.append((int(lo, 16), int(hi, 16)))
            continue
        letters = np.array([unicodedata.category(chr(k))[0] == "L" for k in range(0x110000)])
        letters[0x2EBF0:0x2EE5E] = False  # 15.1
        edges = np.flatnonzero(np.diff(letters.astype(np.int8), prepend=0, append=0)).tolist()
        out += [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def counts(c: Column, p: ScriptProfile = HAN) -> Column:
    """(script, letters, digits, percents, news, report) of a text, all in one pass over its code points.

    What the builders above count by a regex for each measure; for whole texts, not inside lambdas.
    """
    kinds = [_ranges(p.letters), _ranges(rf"\p{{L}}{p.letters}"), [(0x30, 0x39)]]
    names = ["script", "letters", "digits", "percents", "news", "report"]
    news, report = "|".join(NEWS_WORDS), "|".join(REPORT_WORDS) + "|報[0-9]"
    part = 1 << 20  # code points looked up at once: memory does not grow with texts or batches

    @F.arrow_udf(f"struct<{','.join(f'{n}:int' for n in names)}>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(0x110000, np.uint8)
        for k, ranges in enumerate(kinds):
            for lo, hi in ranges:
                table[lo : hi + 1] |= 1 << k
        found = [re.compile(news).findall, re.compile(report).findall]

        def tally(out: np.ndarray, rows: list[int], pieces: list[str]) -> None:
            if pieces:
                sizes = np.array([len(x) for x in pieces])
                kind = table[np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")]
                for k in range(len(kinds)):
                    np.add.at(out[k], rows, np.add.reduceat((kind >> k) & 1, np.cumsum(sizes) - sizes, dtype=np.int64))

        for batch in batches:
            out = np.zeros((len(names), len(batch)), np.int64)
            rows, pieces, size = [], [], 0
            for i, value in enumerate(batch.cast(pa.large_binary())):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                out[3:, i] = text.count("%") + text.count("百分"), len(found[0](text)), len(found[1](text))
                for at in range(0, len(text), part):
                    rows.append(i)
                    pieces.append(text[at : at + part])
                    size += len(pieces[-1])
                    if size >= part:
                        tally(out, rows, pieces)
                        rows, pieces, size = [], [], 0
            tally(out, rows, pieces)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], names, mask=batch.is_null())

    return count(c)


def _density(x: Column, n: Column) -> Column:
    return F.when(n > 0, (x["digits"] + x["percents"]) / n).otherwise(0.0)


def _score(x: Column, n: Column) -> Column:
    return x["news"] * 3 - x["report"] * 1.5 - _density(x, n) * 20


def measures(c: Column, p: ScriptProfile = HAN) -> dict[str, Column]:
    """The measures of whole texts by name, from one pass; ``score`` is the news score of a body without a title."""
    x, n = counts(c, p), F.length(c)
    fraction = F.when(x["letters"] > 0, x["script"] / x["letters"]).otherwise(0.0)
    studyable = (fraction >= p.min_fraction) & (x["script"] >= p.min_chars)
    # Before a body without a title stands one blank.
    return {"script": x["script"], "fraction": fraction, "density": _density(x, n), "studyable": studyable, "score": _score(x, n + 1)}


def news_score(title: Column, body: Column) -> Column:
    t = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    return _score(counts(t), F.length(t))

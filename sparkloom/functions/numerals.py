"""Numerals spelled out, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import SPACE
from .folds import let

DIGITS = "零一二三四五六七八九"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?%?"
# Characters that join the two years of a range; looking back, one more counts.
RANGE = "至到–－~～-"
RANGE_BACK = "至到–—－~～-"


def digits_reading(c: Column) -> Column:
    return F.translate(c, "0123456789", DIGITS)


def _section(four: Column) -> Column:
    """Four digits read with their places; zeros inside collapse later."""
    parts = []
    for i, unit in enumerate("千百十"):
        d = F.substring(four, i + 1, 1)
        parts.append(F.when(d == "0", "零").otherwise(F.concat(digits_reading(d), F.lit(unit))))
    parts.append(digits_reading(F.substring(four, 4, 1)))
    return F.regexp_replace(F.concat(*parts), "零+", "零")


def cardinal_reading(c: Column) -> Column:
    n = F.regexp_replace(c, "^0+(?=[0-9])", "")
    padded = F.lpad(n, 16, "0")
    out = []
    for i, unit in enumerate(["兆", "億", "萬", ""]):
        four = F.substring(padded, 4 * i + 1, 4)
        read = _section(four)
        out.append(F.when(four == "0000", "零").otherwise(F.concat(F.regexp_replace(read, "零$", ""), F.lit(unit), F.lit(""))))
    joined = F.regexp_replace(F.regexp_replace(F.concat(*out), "零+", "零"), "^零|零$", "")
    return F.when(n == "0", "零").when(F.length(n) > 16, digits_reading(n)).otherwise(F.regexp_replace(joined, "^一十", "十"))


def next_meaningful(c: Column) -> Column:
    """The first character that is no blank, or an empty string."""
    return F.regexp_extract(c, "\\A[ 　]*([^ 　])", 1)


def _year_follows(following: Column) -> Column:
    """年 after blanks, or after a range connector and a number.

    Blanks after the connector count twice, so that as many characters after the number are passed over.
    """
    joined = rf"\A[ 　]*[{RANGE}]([{SPACE}]*)[0-9][0-9,]*"
    skipped = F.length(F.regexp_extract(following, joined, 1))
    after = F.regexp_extract(following, rf"(?s){joined}(.*)", 2)
    direct = F.rlike(following, F.lit("\\A[ 　]*年"))
    return direct | (F.rlike(following, F.lit(joined)) & F.rlike(F.substring(after, skipped + 1, F.length(after)), F.lit("\\A[ 　]*年")))


def read_number(raw: Column, following: Column) -> Column:
    """One matched number given the text after it."""
    bare = F.replace(F.regexp_replace(raw, "%$", ""), F.lit(","), F.lit(""))
    whole, part = F.regexp_extract(bare, r"^([0-9]*)", 1), F.regexp_extract(bare, r"\.([0-9]+)$", 1)
    value = F.when(part != "", F.concat(cardinal_reading(whole), F.lit("點"), digits_reading(part))).otherwise(cardinal_reading(whole))
    comma = F.contains(raw, F.lit(","))
    return (
        F.when(F.endswith(raw, F.lit("%")), F.concat(F.lit("百分之"), value))
        .when(part != "", value)
        .when((F.length(bare) >= 3) & ~comma & _year_follows(following), digits_reading(bare))
        .when((F.length(bare) >= 8) & ~comma, digits_reading(bare))
        .otherwise(value)
    )


NEAR = 4  # gaps and numbers after a number that can tell how it is read


def spell_out(text: Column, lookahead: Column | None = None) -> Column:
    """Every number of the text spelled out by its context."""
    after = F.lit("") if lookahead is None else lookahead

    def spelled(t: Column) -> Column:
        return let(F.struct(F.split(t, NUMBER, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)).alias("nums")), lambda x: _spelled(x["gaps"], x["nums"], after))

    return F.when(F.rlike(text, F.lit("[0-9]")), let(text, spelled)).otherwise(text)


def _spelled(gaps: Column, nums: Column, after: Column) -> Column:
    def rest(i: Column) -> Column:
        near = F.zip_with(F.slice(gaps, i + 2, F.lit(NEAR)), F.slice(nums, i + 2, F.lit(NEAR)), lambda g, n: F.concat(F.coalesce(g, F.lit("")), F.coalesce(n, F.lit(""))))
        return F.concat(F.array_join(near, ""), F.when(i + NEAR >= F.size(nums), after).otherwise(""))

    def one(n: Column, i: Column) -> Column:
        return let(F.struct(rest(i).alias("rest"), F.get(gaps, i).alias("gap")), lambda x: F.concat(x["gap"], reading(n, i, x["gap"], x["rest"])))

    def reading(n: Column, i: Column, gap: Column, following: Column) -> Column:
        coded = F.rlike(gap, F.lit("[:：]\\z")) & ~F.rlike(n, F.lit("[.%]"))
        # The second half of a year range: one or two digits after three or more and a connector.
        joined = F.rlike(gap, F.lit(rf"\A[{SPACE}]*[{RANGE_BACK}][{SPACE}]*\z")) & F.rlike(F.coalesce(F.get(nums, F.greatest(i - 1, F.lit(0))), F.lit("")), F.lit("[0-9]{3}\\z"))
        second = (i > 0) & F.rlike(n, F.lit("\\A[0-9]{1,2}\\z")) & joined & (next_meaningful(following) == "年")
        return F.when(coded | second, digits_reading(F.replace(n, F.lit(","), F.lit("")))).otherwise(read_number(n, following))

    return F.concat(F.array_join(F.transform(nums, one), ""), F.element_at(gaps, -1))


def split_by_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"{NUMBER}|[^0-9]+"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.rlike(x, F.lit("^[0-9]")).alias("num")))


def spell_out_pairs(pairs: Column) -> Column:
    """Segments with their spoken side spelled out, each with all later spoken text as its context.

    An unchanged segment is first split around its numbers, so that each number is a segment of its own.
    """
    kind = "array<struct<f:string,c:string>>"
    apart = F.flatten(F.transform(pairs, lambda p: F.when((p["f"] == p["c"]) & F.rlike(p["f"], F.lit("[0-9]")), F.transform(split_by_numbers(p["f"]), lambda t: F.struct(t["text"].alias("f"), t["text"].alias("c")))).otherwise(F.array(p)).cast(kind)))

    def one(ps: Column) -> Column:
        later = lambda i: F.array_join(F.transform(F.slice(ps, i + 2, F.size(ps)), lambda q: q["c"]), "")
        return F.transform(ps, lambda p, i: F.struct(p["f"].alias("f"), spell_out(p["c"], F.when(F.rlike(p["c"], F.lit("[0-9]")), later(i))).alias("c")))

    return let(apart, one)

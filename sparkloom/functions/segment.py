"""Sentence splitting and packing into learning units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import HAN, ScriptProfile, script_count, trim
from .folds import let, scan

UNIT = "struct<text:string,chars:int>"


def sentences(c: Column, p: ScriptProfile = HAN) -> Column:
    b = p.breakers
    found = F.regexp_extract_all(c, F.lit(rf"[^\n{b}]*[{b}]+|[^\n{b}]+"), F.lit(0))
    return F.filter(F.transform(found, lambda s: trim(s)), lambda s: s != "")


def pack(c: Column, p: ScriptProfile = HAN, least: int = 7, most: int = 15) -> Column:
    """Greedy left to right: a short unit takes the next sentence if both fit."""
    pieces = F.transform(sentences(c, p), lambda s: F.struct(s.alias("text"), script_count(s, p).alias("chars")))
    none = F.array().cast(f"array<{UNIT}>")

    def step(unit: Column, x: Column) -> tuple[Column, Column]:
        joined = F.struct(F.concat(unit["text"], x["text"]).alias("text"), (unit["chars"] + x["chars"]).alias("chars"))
        grows = F.coalesce((unit["chars"] < least) & (unit["chars"] + x["chars"] <= most), F.lit(False))
        return F.when(grows, joined).otherwise(x), F.when(grows | unit.isNull(), none).otherwise(F.array(unit))

    return scan(pieces, UNIT, F.lit(None).cast(UNIT), step, lambda unit: F.array(unit))


def paragraphs(c: Column, p: ScriptProfile = HAN) -> Column:
    return F.filter(F.transform(F.split(c, p.paragraph), lambda x: trim(x)), lambda x: x != "")


def paragraphs_or_whole(c: Column, p: ScriptProfile = HAN) -> Column:
    """The paragraphs; where there is none, the text itself unless it is blank."""
    return let(paragraphs(c, p), lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.filter(F.array(trim(c)), lambda x: x != "")))


def batches(position: Column, size: int) -> Column:
    return F.floor((position - 1) / size).cast("int")

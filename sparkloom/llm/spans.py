"""Regex spans with code-point offsets, as native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import folds

SPAN = "struct<s:int,k:int,e:int,m:string>"


def find(text: Column, pattern: str, kind: int, needs: str | None = None) -> Column:
    """``array<struct<s,k,e,m>>`` of the leftmost non-overlapping matches, in order.

    The pieces between the matches come from ``split`` with the same pattern; start offsets are the
    running sum of piece and match lengths.  ``needs`` is a character without which nothing matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs is not None:
        hits = F.when(F.contains(text, F.lit(needs)), hits).otherwise(F.array().cast("array<string>"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        return end, F.array(F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("m")))

    def located(ms: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms))
        return folds.scan(F.zip_with(gaps, ms, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), SPAN, F.lit(0), step)

    found = F.get(
        F.transform(F.array(hits), lambda ms: F.when(F.size(ms) > 0, located(ms)).otherwise(F.array().cast(f"array<{SPAN}>"))), F.lit(0)
    )
    return found


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda x: test(x["m"]))


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")

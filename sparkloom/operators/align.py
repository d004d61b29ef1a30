"""Alignment and lenient grading.  The back-trace needs the whole matrix, hence Arrow UDFs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import only_script
from ..functions.numerals import spell_out

# Spoken characters and the written ones they stand for.
SPOKEN = "係喺嘅咗唔冇佢哋畀食飲睇嚟諗搵揾攞郁嗰呢同講話乜"
WRITTEN = "是在的了不沒他們給吃喝看來想找找拿動那這和說說甚"

_PAIRS = T.ArrayType(T.StructType([T.StructField("f", T.StringType()), T.StructField("c", T.StringType())]))


def _suffix_lcs(a: str, b: str) -> np.ndarray:
    x, y = np.array(list(a)), np.array(list(b))
    t = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        take = np.where(x[i] == y, t[i + 1, 1:] + 1, t[i + 1, :-1])
        t[i, :-1] = np.maximum.accumulate(np.maximum(take, t[i + 1, :-1])[::-1])[::-1]
    return t


def align(f: str | None, c: str | None) -> list[dict] | None:
    """Segments of equal and changed runs; lone equal characters between changes join them."""
    if not f or not c:
        return None
    t, i, j, runs = _suffix_lcs(f, c), 0, 0, []

    def add(same: bool, x: str, y: str) -> None:
        if runs and runs[-1][0] == same:
            runs[-1][1] += x
            runs[-1][2] += y
        else:
            runs.append([same, x, y])

    while i < len(f) or j < len(c):
        if i < len(f) and j < len(c) and f[i] == c[j]:
            add(True, f[i], c[j])
            i, j = i + 1, j + 1
        elif j == len(c) or (i < len(f) and t[i + 1, j] >= t[i, j + 1]):
            add(False, f[i], "")
            i += 1
        else:
            add(False, "", c[j])
            j += 1
    k = 1
    while k < len(runs) - 1:
        if runs[k][0] and len(runs[k][1]) == 1 and not runs[k - 1][0] and not runs[k + 1][0]:
            runs[k - 1 : k + 2] = [[False, *("".join(r[n] for r in runs[k - 1 : k + 2]) for n in (1, 2))]]
            k = max(1, k - 1)
        else:
            k += 1
    return [{"f": x, "c": y} for _, x, y in runs]


def _edit_rows(a: str, b: str) -> np.ndarray:
    """The edit distances of all prefixes, a row at a time."""
    y, step = np.array(list(b)), np.arange(len(b) + 1, dtype=np.int32)
    d = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    d[0] = step
    for i, ch in enumerate(a, 1):
        new = np.append(np.int32(i), np.minimum(d[i - 1, :-1] + (y != ch), d[i - 1, 1:] + 1)) if len(b) else np.array([i], np.int32)
        d[i] = np.minimum.accumulate(new - step) + step
    return d


def align_sequences(a: str | None, b: str | None) -> list[dict]:
    """A least-edit path as (ai, bj, match) in order, -1 for a side that has no character there.

    Looking back from the end a replaced or equal pair comes first, then a lost character, then an added one.
    """
    a, b = a or "", b or ""
    d, i, j, out = _edit_rows(a, b), len(a), len(b), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append({"ai": i, "bj": j, "match": a[i] == b[j]})
        elif i and (not j or d[i, j] == d[i - 1, j] + 1):
            i -= 1
            out.append({"ai": i, "bj": -1, "match": False})
        else:
            j -= 1
            out.append({"ai": -1, "bj": j, "match": False})
    return out[::-1]


def match_places(a: str, b: str) -> list[int]:
    """For each character of ``a`` the place in ``b`` it meets on a least-edit path, or -1."""
    return [p["bj"] for p in align_sequences(a, b) if p["ai"] >= 0]


align_pairs = F.udf(align, _PAIRS, useArrow=True)
_MATCHES = T.ArrayType(T.StructType([T.StructField("ai", T.IntegerType()), T.StructField("bj", T.IntegerType()), T.StructField("match", T.BooleanType())]))
sequence_pairs = F.udf(align_sequences, _MATCHES, useArrow=True)
_places = F.udf(match_places, T.ArrayType(T.IntegerType()), useArrow=True)


def canonical(c: Column, script: tuple[str, str] = ("", "")) -> Column:
    """Spoken characters as written ones, then the caller's script table (from, to), character by character."""
    written = F.translate(c, SPOKEN, WRITTEN)
    return F.translate(written, *script) if script[0] else written


def is_homophone(a: Column, b: Column, table: Column, script: tuple[str, str] = ("", "")) -> Column:
    """Whether two characters share a reading; unknown characters share none.

    ``table`` maps a character to its readings; with ``script`` a character is looked up in its converted
    form first and as it is second.
    """

    def readings(ch: Column) -> Column:
        own = F.try_element_at(table, ch)
        return F.coalesce(F.try_element_at(table, F.translate(ch, *script)), own) if script[0] else own

    return F.coalesce(F.arrays_overlap(readings(a), readings(b)), F.lit(False))


def grade(df: DataFrame, target: str, heard: str, readings: Column, script: tuple[str, str] = ("", ""), lookup: tuple[str, str] = ("", "")) -> DataFrame:
    """``df`` with accuracy, heard_text and marks; a character is right if equal or of a shared reading.

    ``script`` is the table both sides are compared in, ``lookup`` the one that readings are kept in.
    """
    t, h = only_script(F.coalesce(F.col(target), F.lit(""))), only_script(spell_out(F.coalesce(F.col(heard), F.lit(""))))
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    # The UDF's column stands alone: Spark cannot evaluate Python inside a lambda.
    df = df.withColumns({"_t": t, "heard_text": h}).withColumn("_p", _places(canonical(F.col("_t"), script), canonical(F.col("heard_text"), script)))

    def mark(other_chars: Column):
        def one(ch: Column, i: Column) -> Column:
            other = F.get(other_chars, F.when(F.get(F.col("_p"), i) >= 0, F.get(F.col("_p"), i)))
            ok = F.coalesce(canonical(ch, script) == canonical(other, script), F.lit(False))
            return F.struct(ch.alias("char"), ok.alias("ok"), (~ok & is_homophone(ch, other, readings, lookup)).alias("sound"))

        return one

    df = df.withColumn("marks", F.transform(chars(F.col("_t")), mark(chars(F.col("heard_text")))))
    right = F.size(F.filter("marks", lambda m: m["ok"] | m["sound"]))
    return df.withColumn("accuracy", F.when(F.size("marks") > 0, right / F.size("marks")).otherwise(0.0)).drop("_t", "_p")


def percent(accuracy: Column) -> Column:
    """Rounded half up."""
    return F.floor(accuracy * 100 + 0.5).cast("int")


def band(accuracy: Column) -> Column:
    return F.when(percent(accuracy) >= 80, "good").otherwise("mid")


def mark_class(mark: Column) -> Column:
    return F.when(mark["ok"], "ok").when(mark["sound"], "soft").otherwise("bad")

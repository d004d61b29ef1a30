"""Longest-match rewriting with aligned segments.  The rule table is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import let, scan

# A starter table.  A caller's table may hold hundreds of keys; a key that maps to
# itself protects a word from shorter rules.
STARTER = {
    "是": "係", "的": "嘅", "他": "佢", "她": "佢", "他們": "佢哋", "她們": "佢哋", "我們": "我哋", "你們": "你哋", "這": "呢", "那": "嗰",
    "沒有": "冇", "現在": "而家", "說": "話", "和": "同", "認為": "覺得", "目的": "目的", "了解": "了解", "是否": "是否", "其他": "其他", "和平": "和平", "說明": "說明",
}


SEGMENT = "struct<f:string,c:string>"
#: The kinds of a table's rows, from the weakest: of equal keys the last kind wins.
KINDS = ["char", "phrase", "protect"]
MOST_RULES = 10_000


def load_rules(table: DataFrame) -> dict[str, str]:
    """Rules from a landed table (k, v, kind): a protected key maps to itself, later kinds win.

    The table becomes part of the plan, so its size is checked.
    """
    rows = table.where("k <> ''").select("k", "v", "kind").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out: dict[str, str] = {}
    for kind in KINDS:
        out |= {r["k"]: r["k"] if kind == "protect" else r["v"] or "" for r in sorted(rows, key=lambda r: r["k"]) if r["kind"] == kind}
    return out


def keys_longest_first(rules: dict[str, str]) -> list[str]:
    return sorted(rules, key=lambda k: (-len(k), k))


def token_pattern(rules: dict[str, str]) -> str:
    """Quotations, keys from the longest, single characters; the first that fits is the token."""
    return "「[^」]*」?|《[^》]*》?|『[^』]*』?|" + "|".join(map(re.escape, keys_longest_first(rules))) + "|[\\s\\S]"


def segments(text: Column, rules: dict[str, str] = STARTER) -> Column:
    """``array<struct<f,c>>``: quotations stay, else the longest rule, else one character."""
    keys = keys_longest_first(rules)
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, rules[k])])

    def rewrite(ts: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            nxt = F.substring(F.coalesce(F.get(ts, i + 1), F.lit("")), 1, 1)
            past = F.when(nxt.isin("", "。", "！", "？"), "喇").otherwise("咗")
            c = F.when(t == "了", past).when(t.isin(*keys), F.element_at(table, t)).otherwise(t)
            return F.struct(t.alias("f"), c.alias("c"))

        return F.transform(ts, one)

    def step(run: Column, x: Column) -> tuple[Column, Column]:
        same = F.coalesce((run["f"] == run["c"]) & (x["f"] == x["c"]), F.lit(False))
        joined = F.struct(F.concat(run["f"], x["f"]).alias("f"), F.concat(run["c"], x["c"]).alias("c"))
        return F.when(same, joined).otherwise(x), F.when(same | run.isNull(), F.array().cast(f"array<{SEGMENT}>")).otherwise(F.array(run))

    parts = let(F.regexp_extract_all(text, F.lit(token_pattern(rules)), F.lit(0)), rewrite)
    return scan(parts, SEGMENT, F.lit(None).cast(SEGMENT), step, lambda run: F.array(run))


def rewrite(text: Column, rules: dict[str, str] = STARTER) -> Column:
    return F.array_join(F.transform(segments(text, rules), lambda s: s["c"]), "")


def valid_pairs(pairs: Column, f: Column, c: Column) -> Column:
    """The pairs without empty ones if there are any and they join to both texts, else null."""
    full = F.filter(F.transform(pairs, lambda p: F.struct(F.coalesce(p["f"], F.lit("")).alias("f"), F.coalesce(p["c"], F.lit("")).alias("c"))), lambda p: (p["f"] != "") | (p["c"] != ""))
    ok = (F.size(full) > 0) & (F.array_join(F.transform(full, lambda p: p["f"]), "") == f) & (F.array_join(F.transform(full, lambda p: p["c"]), "") == c)
    return F.when(ok, full)


def is_changed(formal: Column, colloquial: Column) -> Column:
    return ~formal.eqNullSafe(colloquial)

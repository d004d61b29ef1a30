"""Tool-call linking: calls and results joined by identifier, ordered, validated, serialised.

A call is linked to the result of the same (conversation, identifier) by a hash join; with repeated
identifiers the earliest call meets the earliest result, the second the second and so on, and calls
beyond the first are ``extra`` (rows of one turn in the order of their content).  Calls name the calls
they depend on.  Their topological level is the longest chain of dependencies before them, of any
length; calls on a cycle, or after one, get level -1.  Chains of calls with one dependency each are
followed by pointer doubling, in rounds that grow with the log of their length; calls with several
are peeled, one round for each such call on a path.  A dependency on an identifier that no call of the
conversation has is no dependency.

Arguments are checked against their tool's schema: required keys, types, and no unknown keys.  Strict
JSON alone is accepted: NaN and infinite numbers are malformed, as are values nested deeper than
``DEEPEST``.  Canonical JSON has sorted keys (by code point; of repeated keys the last), no blanks and
UTF-8 text; half a surrogate pair, which UTF-8 cannot hold, stays escaped.  Malformed arguments are
serialised as the string they are.

Rows: a call or result whose identifier or conversation is null links with nothing (``nth`` is null) and
has level 0; null or malformed arguments are invalid; repeated rows follow the rule for repeated
identifiers; empty tables give empty results; further columns are not read.  A conversation, or one
identifier, may hold any share of the rows: nothing is gathered per conversation, and only repeated
identifiers are numbered, by a distributed sort.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import numbered_within
from .scratch import Stage

DEEPEST = 200
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"?', re.S)
_HALF = re.compile("[\ud800-\udfff]")


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    x = float(text)
    return x if math.isfinite(x) else _refuse(text)


def strict_json(text: str):
    """The value of strict JSON text; anything else is a ValueError."""
    if text.count("[") + text.count("{") > DEEPEST:
        depth = most = 0
        for c in re.findall(r"[\[\]{}]", _STRING.sub("", text)):
            depth += 1 if c in "[{" else -1
            most = max(most, depth)
        if most > DEEPEST:
            raise ValueError("nested too deep")
    return json.loads(text, parse_constant=_refuse, parse_float=_finite)


def check_arguments(text: str | None, schema: dict | None) -> str:
    """``ok``, or what is wrong first."""
    try:
        args = strict_json(text) if text is not None else None
    except ValueError:
        return "malformed"
    if schema is None:
        return "unknown tool"
    if not isinstance(args, dict):
        return "not an object"
    for k in schema.get("required", []):
        if k not in args:
            return f"missing {k}"
    for k in sorted(args):
        want = schema.get("properties", {}).get(k)
        if want is None:
            return _utf8(f"unknown {k}")
        kind = _TYPES[want["type"]]
        if not isinstance(args[k], kind) or (isinstance(args[k], bool) and want["type"] in ("integer", "number")):
            return f"type of {k}"
        if isinstance(args[k], str) and len(args[k]) < want.get("minLength", 0):
            return f"length of {k}"
    return "ok"


def _utf8(text: str) -> str:
    """Half surrogate pairs as escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _utf8(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without a call.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (array of call_id);
    results: conv_id, call_id, turn, content.
    """
    spark = calls.sparkSession
    stage = Stage(spark, "calls")
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on", F.lit(True).alias("is_call"))
    results = results.select("conv_id", "call_id", "turn", "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    c = _nth(calls.where(named), F.xxhash64("name", "arguments", "depends_on"), stage, "c")
    r = _nth(results.where(named), F.xxhash64("content"), stage, "r").select("conv_id", "call_id", "nth", F.col("turn").alias("result_turn"), "content")
    none = F.lit(None).cast("long").alias("nth")
    linked = c.join(r, ["conv_id", "call_id", "nth"], "full")
    linked = linked.unionByName(calls.where(~named).select("*", none), allowMissingColumns=True)
    linked = linked.unionByName(results.where(~named).select("conv_id", "call_id", none, F.col("turn").alias("result_turn"), "content"), allowMissingColumns=True)
    is_call = F.coalesce("is_call", F.lit(False))
    status = F.when(~is_call, "orphan result").when(F.col("result_turn").isNull(), "open").when(F.col("nth") > 1, "extra").when(F.col("result_turn") < F.col("turn"), "early result").otherwise("linked")
    number = isinstance(calls.schema["conv_id"].dataType, T.IntegralType)

    @F.pandas_udf("string")
    def checked(name: pd.Series, args: pd.Series, call: pd.Series) -> pd.Series:
        return pd.Series([check_arguments(a, schemas.get(n)) if is_one else None for n, a, is_one in zip(name, args, call, strict=True)])

    @F.pandas_udf("string")
    def serial(conv: pd.Series, call: pd.Series, name: pd.Series, args: pd.Series, content: pd.Series) -> pd.Series:
        def one(v, i, n, a, t):
            try:
                a = strict_json(a) if a is not None else None
            except ValueError:
                pass
            return canonical({"arguments": a, "call": i, "conversation": int(v) if v is not None and number else v, "name": n, "result": t})

        return pd.Series([one(*x) for x in zip(conv, call, name, args, content, strict=True)])

    text = F.col("conv_id").cast("string")  # a long with nulls would reach pandas as a double
    cols = ["conv_id", "call_id", "nth", "turn", "result_turn", "name", status.alias("status"), checked("name", "arguments", is_call).alias("arguments_ok")]
    base = stage.table(linked.select(*cols, is_call.alias("called"), serial(text, F.col("call_id"), F.col("name"), F.col("arguments"), F.col("content")).alias("json")), "linked")
    nodes = calls.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.lit(0).alias("level"))
    edges = stage.table(calls.select("conv_id", "call_id", F.explode("depends_on").alias("before")).where("before IS NOT NULL").distinct(), "edges")
    edges = stage.table(edges.join(nodes.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi"), "known")
    level = F.when(F.col("called"), F.coalesce("level", F.lit(0)))
    levels = levels_of(edges, stage)
    return base.join(levels, ["conv_id", "call_id"], "left").withColumn("level", level).drop("called")


def _nth(rows: DataFrame, content: Column, stage: Stage, label: str) -> DataFrame:
    """``rows`` with their number within the identifier, by turn and content; only repeated identifiers are sorted."""
    key = ["conv_id", "call_id"]
    often = stage.table(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*key), f"{label}-often")
    if often.isEmpty():
        return rows.withColumn("nth", F.lit(1).cast("long"))
    once = rows.join(often, key, "left_anti").withColumn("nth", F.lit(1).cast("long"))
    many = stage.table(rows.join(often, key, "left_semi").withColumns({"_c": content, "_row": F.monotonically_increasing_id()}), f"{label}-many")
    many = numbered_within(many, key, [F.col("turn").asc_nulls_last(), F.col("_c"), F.col("_row")], stage, f"{label}-nth", "nth")
    return once.unionByName(many.drop("_c", "_row"))


def levels_of(edges: DataFrame, stage: Stage) -> DataFrame:
    """(conv_id, call_id, level) of the calls that depend on others, of distinct edges (conv_id, call_id, before)."""
    node = ["conv_id", "call_id"]
    counted = edges.where("call_id IS NOT NULL").groupBy(*node).agg(F.count(F.lit(1)).alias("m"), F.min("before").alias("to"))
    counted = stage.table(counted, "counted")
    # Calls with one dependency: the first call up their chain that has none or several, and its distance.
    jumps = stage.table(counted.where("m = 1").select(*node, "to", F.lit(1).cast("long").alias("d"), F.lit(True).alias("moving")), "jumps")
    most, k, moving = jumps.count(), 0, True
    while moving and 2**k < 4 * most:  # after that only calls on a cycle, or after one, still move
        k += 1
        on = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        jumps = jumps.join(on, ["conv_id", "to"], "left").select(*node, F.coalesce("to2", "to").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("to2").isNotNull().alias("moving"))
        jumps = stage.table(jumps, f"jumps{k}")
        moving = not jumps.where("moving").isEmpty()
    # Calls with several: the same for each dependency; base is the level that it asks for, once known.
    several = counted.where("m > 1").select(*node)
    up = jumps.select("conv_id", F.col("call_id").alias("before"), "to", "d", "moving")
    held = edges.join(several, node, "left_semi").join(up, ["conv_id", "before"], "left")
    held = held.select(*node, F.coalesce("to", "before").alias("to"), (F.coalesce("d", F.lit(0)) + 1).alias("d"), F.coalesce("moving", F.lit(False)).alias("moving"))
    waits = several.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("waits"))
    held = held.join(waits, ["conv_id", "to"], "left").select(*node, "to", "d", F.when(~F.col("moving") & F.col("waits").isNull(), F.col("d")).alias("base"))
    held, k, ready = stage.table(held, "held"), 0, []
    while True:
        done = held.groupBy(*node).agg(F.max("base").alias("level"), F.min(F.col("base").isNotNull()).alias("all")).where("all").select(*node, "level")
        done = stage.table(done, f"ready{k}")
        ready.append(stage.paths[f"ready{k}"])
        if done.isEmpty():
            break
        up = done.select("conv_id", F.col("call_id").alias("to"), "level")
        rest = held.join(done.select(*node), node, "left_anti").join(up, ["conv_id", "to"], "left")
        k += 1
        held = stage.table(rest.select(*node, "to", "d", F.coalesce("base", F.col("level") + F.col("d")).alias("base")), f"held{k}")
    known = edges.sparkSession.read.schema(done.schema).parquet(*ready)
    joints = stage.table(several.join(known, node, "left").select(*node, F.coalesce("level", F.lit(-1)).alias("level")), "joints")
    up = joints.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("at"))
    level = F.when(F.col("moving") | (F.col("at") < 0), -1).otherwise(F.col("d") + F.coalesce("at", F.lit(0)))
    chains = jumps.join(up, ["conv_id", "to"], "left").select(*node, level.alias("level"))
    out = stage.table(chains.unionByName(joints).withColumn("level", F.col("level").cast("int")), "levels")
    stage.keep("linked", "levels")
    return out


#: The schemas of the calls that the conversations table is read as.
_TEXT, _TURN = {"type": "string", "minLength": 1}, {"type": "integer"}
REPLY = {
    "reply": {"required": ["prompt", "turn"], "properties": {"prompt": _TEXT, "turn": _TURN}},
    "instruct": {"required": ["text", "turn"], "properties": {"text": _TEXT, "turn": _TURN}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversations table as calls and results.

    A user turn calls ``reply`` for the assistant's text in the next turn; a turn of any role but user and
    assistant (system turns) calls ``instruct``, which has no result.  A call depends on the call of the
    turn before it or, where that is an assistant's, of the turn before that.  An assistant's turn after
    no user turn is a result without a call.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    callers, replies = t.where("role <> 'assistant'"), t.where("role = 'assistant'")
    is_user = F.col("role") == "user"
    arguments = F.when(is_user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct("text", "turn")))
    # The call of the turn before always is a dependency; that of two turns before only if it waits for a reply.
    after = lambda rows, n: rows.select("conv_id", (F.col("turn") + n).alias("turn"), name(F.col("turn")).alias(f"call{n}")).distinct()
    calls = callers.join(after(callers, 1), ["conv_id", "turn"], "left").join(after(callers.where(is_user), 2), ["conv_id", "turn"], "left").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(is_user, "reply").otherwise("instruct").alias("name"), arguments.alias("arguments"),
        F.array_compact(F.array(F.coalesce("call1", "call2"))).alias("depends_on"),
    )
    return calls, replies.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))

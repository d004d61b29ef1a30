"""Folds over arrays that emit elements as they go, for texts of any length.

Spark copies a fold's state at every step, so that a result that grows in the state costs n squared.
Here the array is cut into parts of the root of its length: a fold over the parts holds the results of
whole parts, and inside it a fold over one part's elements holds that part's results alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(xs: Column, element: str, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], end: Callable[[Column], Column] | None = None) -> Column:
    """The array of what ``step`` emits: it takes the state and an element of ``xs`` to the next state and an
    array of ``element``; ``end`` gives a last array from the last state."""

    def fold(xs: Column) -> Column:
        part = F.greatest(F.lit(PART), F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"))

        def folded(part: Column) -> Column:
            def inner(a: Column, x: Column) -> Column:
                new, out = step(a["state"], x)
                return F.struct(new.alias("state"), F.concat(a["out"], out).alias("out"))

            def outer(a: Column, i: Column) -> Column:
                begun = F.struct(a["state"].alias("state"), F.array().cast(f"array<{element}>").alias("out"))
                done = F.aggregate(F.slice(xs, i * part + 1, part), begun, inner)
                return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out")))

            parts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / part).cast("int"))
            start = F.struct(state.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
            ended = (lambda a: F.flatten(F.concat(a["out"], F.array(end(a["state"]))))) if end else (lambda a: F.flatten(a["out"]))
            return F.aggregate(parts, start, outer, ended)

        return let(part, folded)

    nothing = F.array().cast(f"array<{element}>")
    return let(xs, lambda a: F.when(F.size(a) > 0, fold(a)).otherwise(F.when(a.isNotNull(), nothing)))

"""Speech sessions over recogniser events, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SILENCE = "3500 milliseconds"
# Fixed values, in seconds: the silence that ends a session, the wait for its first word, its longest time.
QUIET, START, LONGEST = 3.5, 8.0, 45.0
RESTARTS = 60
FATAL = ["not-allowed", "service-not-allowed", "audio-capture"]


def sessions(events: DataFrame, who: str, ts: str, gap: str = SILENCE, late: str | None = None) -> DataFrame:
    """(who, start, stop, events); a stream needs ``late``, its watermark."""
    if late is not None:
        events = events.withWatermark(ts, late)
    found = events.groupBy(F.col(who), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("stop"))
    return found.select(who, F.col("w.start").alias("start"), "stop", "n")


def _blank(c):
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def listen(events: DataFrame) -> DataFrame:
    """(session_id, start, stop, reason, transcript) of recogniser events.

    events: (session_id, ts, ord, kind, final, interim, error); kind is start, result, end, error or stop; a result
    carries all finals and the interim text of its run so far.  A session stops at the first of: a fatal error, the
    speaker's stop, ``LONGEST`` after its start, ``START`` without a word, ``QUIET`` after the last word, and the
    end of a run past ``RESTARTS`` restarts.  Another end restarts the recogniser and carries the finals on.  What
    comes after the stop is not heard.  The transcript is the finals of all runs and the last interim text.
    """
    order = W.partitionBy("session_id").orderBy("ts", "ord")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("session_id")
    at = F.col("ts").cast("double")
    text = F.concat(F.coalesce("final", F.lit("")), F.coalesce("interim", F.lit("")))
    is_result = F.col("kind") == "result"
    rows = events.withColumns({"t": at, "begin": F.min(at).over(every), "run": F.coalesce(F.count_if(F.col("kind") == "end").over(before), F.lit(0))})
    # Once finals are carried on, any result counts as speech.
    run_final = F.last(F.when(is_result, F.coalesce("final", F.lit(""))), ignorenulls=True).over(W.partitionBy("session_id", "run").orderBy("ts", "ord").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("carried", F.when((F.col("kind") == "end") & ~_blank(run_final), True))
    rows = rows.withColumn("spoken", is_result & (~_blank(text) | F.coalesce(F.max("carried").over(before), F.lit(False))))
    word = F.when(F.col("spoken"), F.col("t"))
    rows = rows.withColumn("next_word", F.min(word).over(order.rowsBetween(1, W.unboundedFollowing)))
    first = F.min(word).over(every)
    quiet = F.when(F.col("spoken") & (F.coalesce(F.col("next_word") - F.col("t"), F.lit(float("inf"))) > QUIET), F.col("t") + QUIET)
    silent = F.when(F.coalesce(first, F.lit(float("inf"))) > F.col("begin") + START, F.col("begin") + START)
    fatal = F.when((F.col("kind") == "error") & F.col("error").isin(FATAL), F.col("t"))
    asked = F.when(F.col("kind") == "stop", F.col("t"))
    worn = F.when((F.col("kind") == "end") & (F.col("run") > RESTARTS), F.col("t"))
    reasons = {"fatal": F.min(fatal).over(every), "stopped": F.min(asked).over(every), "longest": F.col("begin") + LONGEST, "no word": silent, "silence": F.min(quiet).over(every), "restarts": F.min(worn).over(every)}
    rows = rows.withColumns({f"_{i}": c for i, c in enumerate(reasons.values())})
    stop = F.least(*[F.col(f"_{i}") for i in range(len(reasons))])
    reason = F.coalesce(*[F.when(F.col(f"_{i}") == F.col("stop"), name) for i, name in enumerate(reasons)])
    heard = rows.withColumn("stop", stop).withColumn("reason", reason).where(F.col("t") <= F.col("stop"))
    last = F.max(F.when(is_result, F.struct("t", "ord", F.coalesce("final", F.lit("")).alias("final"), F.coalesce("interim", F.lit("")).alias("interim"))))
    ended = F.max((F.col("kind") == "end") & (F.col("t") < F.col("stop"))).alias("ended")
    runs = heard.groupBy("session_id", "begin", "stop", "reason", "run").agg(last.alias("last"), ended)
    # A run that ended keeps its finals only.
    said = F.concat(F.coalesce("last.final", F.lit("")), F.when(F.col("ended"), "").otherwise(F.coalesce("last.interim", F.lit(""))))
    whole = runs.groupBy("session_id", "begin", "stop", "reason").agg(F.array_sort(F.collect_list(F.struct("run", said.alias("said")))).alias("xs"))
    text = F.trim(F.array_join(F.transform("xs", lambda x: x["said"]), ""))
    return whole.select("session_id", F.timestamp_seconds("begin").alias("start"), F.timestamp_seconds("stop").alias("stop"), "reason", text.alias("transcript"))


class Hearing:
    """The same state machine, event by event, for streams."""

    def __init__(self, state: tuple | None):
        self.begin, self.word, self.committed, self.final, self.interim, self.ends = state or (None, None, "", "", "", 0)

    def state(self) -> tuple:
        return self.begin, self.word, self.committed, self.final, self.interim, self.ends

    def deadline(self) -> float:
        """When the session stops if nothing more is said."""
        longest = self.begin + LONGEST
        return min(longest, self.begin + START if self.word is None else self.word + QUIET)

    def why(self) -> str:
        return "longest" if self.deadline() == self.begin + LONGEST else "no word" if self.word is None else "silence"

    def transcript(self) -> str:
        return (self.committed + self.final + self.interim).strip()

    def take(self, t: float, kind: str, final: str | None, interim: str | None, error: str | None) -> tuple[float, str] | None:
        """(stop, reason) if the session is over by this event."""
        if self.begin is None:
            self.begin = t
        if t > self.deadline():
            return self.deadline(), self.why()
        if kind == "result":
            self.final, self.interim = final or "", interim or ""
            if self.transcript():
                self.word = t
        elif kind == "error" and error in FATAL:
            return t, "fatal"
        elif kind == "stop":
            return t, "stopped"
        elif kind == "end":
            if self.ends > RESTARTS:
                return t, "restarts"
            self.committed, self.final, self.interim, self.ends = self.committed + self.final, "", "", self.ends + 1
        return None


_OUT = "session_id string, start double, stop double, reason string, transcript string"
_STATE = "begin double, word double, committed string, final string, interim string, ends int, done boolean"


def listen_stream(events: DataFrame, late: str = "60 seconds") -> DataFrame:
    """``listen`` over a stream: a session is given out once it is over, by an event or by the watermark.

    Events must come in order within a session; those after its stop are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if held is not None and held[-1]:
            return
        h, over = Hearing(tuple(None if pd.isna(x) else x for x in held[:-1]) if held is not None else None), None
        if state.hasTimedOut:
            over = (h.deadline(), h.why())
        else:
            for rows in batches:
                for r in rows.sort_values(["t", "ord"]).itertuples():
                    over = over or h.take(r.t, r.kind, r.final, r.interim, r.error)
        state.update((*h.state(), over is not None))
        if over is not None:
            yield pd.DataFrame([(key[0], h.begin, *over, h.transcript())], columns=["session_id", "start", "stop", "reason", "transcript"])
        elif h.begin is not None:
            state.setTimeoutTimestamp(max(int(h.deadline() * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", late).withColumn("t", F.col("ts").cast("double"))
    rows = rows.select("session_id", "ts", "t", "ord", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("final", "interim", "error")])
    return rows.groupBy("session_id").applyInPandasWithState(step, _OUT, _STATE, "append", "EventTimeTimeout")

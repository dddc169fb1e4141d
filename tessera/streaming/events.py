"""Streams of change events: collapse by key, and windows of activity, with watermarks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def next_state(state: str, kind: str) -> str:
    """What two events in a row amount to; '' is nothing."""
    if state == "created" and kind == "deleted":
        return ""
    if state == "created" and kind == "modified":
        return "created"
    return "modified" if state == "deleted" and kind == "created" else kind


def _fold(key, batches, state: GroupState):
    now, seen = state.get if state.exists else ("", 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "id"])
    for kind in rows["kind"]:
        now, seen = next_state(now, kind), seen + 1
    if now == "" and seen:  # created and deleted again: nothing is left to remember
        state.remove()
    else:
        state.update((now, seen))
    yield pd.DataFrame({"path": [key[0]], "state": [now], "n": [seen]})


def collapse_stream(events: DataFrame) -> DataFrame:
    """(path, state, n) updates of a stream of (path, ts, id, kind): each path's events so far as one. State is a word and a
    number for each path that there is something to say of; it goes when the path's events cancel out. n counts since then."""
    return events.groupBy("path").applyInPandasWithState(_fold, "path string, state string, n long", "state string, n long", "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind in windows of event time; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))


def user_sessions(events: DataFrame, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "path").agg(F.count("*").alias("n"))

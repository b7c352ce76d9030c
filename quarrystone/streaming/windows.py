"""The batch operators' streaming forms: watermarked counts, sessions, and pairing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failure_counts(events: DataFrame, failed: Column, source: str = "source", late: str = "10 minutes", size: str = "10 minutes", least: int = 10) -> DataFrame:
    """Failures by source and window, as each window closes; later rows than ``late`` are dropped."""
    rows = events.where(failed).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), source).agg(F.count("*").alias("failures")).where(F.col("failures") >= least).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), source, "failures")


def activity_sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of activity of a key with no pause of ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


PAIRED = "key string, opened timestamp, closed timestamp, state string"


def paired_sessions(events: DataFrame, timeout_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Openings with their closings, last in first out, from (key, ts, step: 1 or -1).

    The state of a key is its stack of openings. After ``timeout_s`` of event
    time without a row the rest are given as still open.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        out: list[tuple] = []
        if state.hasTimedOut:
            out = [(key[0], pd.Timestamp(t, unit="us"), pd.NaT, "still open") for t in stack]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for ts, step in zip(rows["ts"], rows["step"], strict=True):
                if step > 0:
                    stack.append(int(ts.value // 1000))
                elif stack:
                    out.append((key[0], pd.Timestamp(stack.pop(), unit="us"), ts, "closed"))
            state.update((stack,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().value // 1_000_000)) + timeout_s * 1000)
        yield pd.DataFrame(out, columns=["key", "opened", "closed", "state"])

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(pair, PAIRED, "stack array<long>", "append", GroupStateTimeout.EventTimeTimeout)

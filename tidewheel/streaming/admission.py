"""Admission rules over streams: one state a key, in the order of the clock column within each micro-batch.

The rules are those of the batch operators (tidewheel.operators.rules). Streams should arrive about in order: a row older than
the state it meets is judged at the state's time. Keys idle for `idle` milliseconds are dropped, if it
is given; a query with such a timeout keeps making batches, so one that should end when its input does goes without."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.operators.rules import SlidingWindow, Sometimes, Throttle, TokenBucket

__all__ = ["SlidingWindow", "Sometimes", "Throttle", "TokenBucket", "admitted", "correlated", "debounced", "once_per_key", "routed", "windowed_counts"]


def admitted(df: DataFrame, key: str, at: str, tie: str, rule, idle: int | None = None) -> DataFrame:
    """The rows of a streaming DataFrame that the rule lets pass: key, `at` (microseconds), `tie`."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else rule.first()
        rows = pd.concat(list(batches)).sort_values([at, tie])
        keep = []
        for t in rows[at].tolist():
            ok, now = rule.step(now, int(t))
            keep.append(ok)
        state.update((json.dumps(now),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield rows.loc[keep, [key, at, tie]]

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, at, tie))
    return df.select(key, at, tie).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def once_per_key(df: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first row of each key within a time; state is bounded by the watermark."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def debounced(df: DataFrame, key: str, ts: str, quiet: str, late: str) -> DataFrame:
    """key, the time of the last row and the rows of each stretch that a quiet time ended."""
    w = df.withWatermark(ts, late).groupBy(F.session_window(ts, quiet), key)
    return w.agg(F.max(ts).alias("last"), F.count("*").alias("rows")).select(key, "last", "rows")


def windowed_counts(df: DataFrame, ts: str, width: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Counts over sliding windows; rows later than the watermark are dropped and show up in the query's progress."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))


def correlated(requests: DataFrame, replies: DataFrame, key: str, at: str, reply_at: str, timeout: str) -> DataFrame:
    """Requests with their replies within a timeout, or null once the watermark has passed it. The replies' key is named as the requests'."""
    a = requests.withWatermark(at, timeout).alias("a")
    b = replies.withWatermark(reply_at, timeout).alias("b")
    near = F.expr(f"a.{key} = b.{key} AND b.{reply_at} >= a.{at} AND b.{reply_at} < a.{at} + INTERVAL {timeout}")
    return a.join(b, near, "leftOuter").select(f"a.{key}", f"a.{at}", f"b.{reply_at}")


def routed(df: DataFrame, kind: str, *kinds: str) -> DataFrame:
    """Subscription by event type; back-pressure instead of drops."""
    return df.where(F.col(kind).isin(*kinds))

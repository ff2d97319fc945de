"""The stateful rules as streams over what the source holds, and parallel maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import parallel, stateful
from tidewheel.plans.registry import ORACLE, query
from tidewheel.plans.state_queries import HOUR
from tidewheel.sources.tables import table
from tidewheel.streaming import admission
from tidewheel.streaming.drain import drained, stream_table


def stream(spark, d):
    """The events as a stream with a clock column in microseconds and a timestamp with zone."""
    ev = stream_table(spark, d, "events", table(spark, d, "events").schema)
    return ev.withColumn("at", stateful.micros("ts")).withColumn("t", F.col("ts").cast("timestamp"))


@query("stream_throttle", ORACLE["throttle"])
def _(spark, d):
    return drained(admission.admitted(stream(spark, d), "user_id", "at", "event_id", admission.Throttle(6 * HOUR))).select("event_id")


@query("stream_sliding_limiter", ORACLE["sliding_limiter"])
def _(spark, d):
    return drained(admission.admitted(stream(spark, d), "user_id", "at", "event_id", admission.SlidingWindow(2, 6 * HOUR))).select("event_id")


@query("stream_token_bucket", ORACLE["token_bucket"])
def _(spark, d):
    rule = admission.TokenBucket(0.00002, 3)
    return drained(admission.admitted(stream(spark, d), "user_id", "at", "event_id", rule)).select("event_id")


@query("stream_routed", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view')")
def _(spark, d):
    return drained(admission.routed(stream(spark, d), "event_type", "click", "view").select("event_id", "user_id"))


@query("stream_once_per_key", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return drained(admission.once_per_key(stream(spark, d), ["user_id", "event_type"], "t", "60 days").select("user_id", "event_type"))


@query("stream_windowed_counts", "SELECT epoch_us(day) AS day, event_type, n FROM (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(spark, d):
    return drained(admission.windowed_counts(stream(spark, d), "t", "1 day", "1 day", "1 hour", "event_type").select(F.unix_micros("window.start").alias("day"), "event_type", "n"))


@query("map_in_order", "SELECT event_id, event_id * 10 AS v FROM events ORDER BY event_id")
def _(spark, d):
    return parallel.map_in_order(table(spark, d, "events").select("event_id"), "event_id", lambda p: p.assign(v=p.event_id * 10), "event_id bigint, v bigint")


@query("map_results", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 60 // (event_id % 3) END AS value, CASE WHEN event_id % 3 = 0 THEN 'integer division or modulo by zero' END AS error FROM events")
def _(spark, d):
    return parallel.map_results(table(spark, d, "events").withColumn("r", F.col("event_id") % 3), "event_id", "r", lambda x: 60 // int(x), "bigint")

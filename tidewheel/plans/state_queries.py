"""Queries of admission, expiry, machines and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import values as V
from tidewheel.operators import stateful
from tidewheel.plans.registry import query
from tidewheel.sources.tables import table

HOUR = 3_600_000_000
SESSION = {("new", "signup"): "member", ("new", "view"): "browsing", ("browsing", "click"): "browsing", ("browsing", "signup"): "member", ("member", "purchase"): "customer", ("customer", "error"): "blocked", ("member", "error"): "blocked", ("blocked", "signup"): "member"}
ORDERED = "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", stateful.micros("ts").alias("at"))


@query("debounce_last", f"SELECT event_id FROM (SELECT event_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM events) WHERE ahead IS NULL OR ahead - us >= {6 * HOUR}")
def _(spark, d):
    return stateful.debounce(events(spark, d), ["user_id"], "at", "event_id", 6 * HOUR).select("event_id")


@query(
    "throttle",
    f"""WITH RECURSIVE e AS ({ORDERED}), r AS (
    SELECT user_id, n, us AS last, true AS ok, event_id FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.n, CASE WHEN e.us - r.last >= {6 * HOUR} THEN e.us ELSE r.last END, e.us - r.last >= {6 * HOUR}, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT event_id FROM r WHERE ok""",
)
def _(spark, d):
    return stateful.throttle(events(spark, d), ["user_id"], "at", "event_id", 6 * HOUR).select("event_id")


@query(
    "sliding_limiter",
    f"""WITH RECURSIVE e AS ({ORDERED}), r AS (
    SELECT user_id, n, -1::BIGINT AS a, us AS b, true AS ok, event_id FROM e WHERE n = 1 UNION ALL
    SELECT e.user_id, e.n, CASE WHEN r.a <= e.us - {6 * HOUR} THEN r.b ELSE r.a END, CASE WHEN r.a <= e.us - {6 * HOUR} THEN e.us ELSE r.b END, r.a <= e.us - {6 * HOUR}, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT event_id FROM r WHERE ok""",
)
def _(spark, d):
    return stateful.sliding_window(events(spark, d), ["user_id"], "at", "event_id", 2, 6 * HOUR).select("event_id")


@query(
    "token_bucket",
    f"""WITH RECURSIVE e AS ({ORDERED}), r AS (
    SELECT user_id, n, 2.0::DOUBLE AS tokens, us AS last, true AS ok, event_id FROM e WHERE n = 1 UNION ALL
    SELECT user_id, n, CASE WHEN have >= 1 THEN have - 1 ELSE tokens END, CASE WHEN have >= 1 THEN us ELSE last END, have >= 1, event_id FROM (
      SELECT e.user_id, e.n, e.us, e.event_id, r.tokens, r.last, least(3.0::DOUBLE, r.tokens + greatest(e.us - r.last, 0) / 1000000.0::DOUBLE * 0.00002::DOUBLE) AS have FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT event_id FROM r WHERE ok""",
)
def _(spark, d):
    return stateful.token_bucket(events(spark, d), ["user_id"], "at", "event_id", 0.00002, 3).select("event_id")


@query(
    "keyed_limiter",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), r AS (
    SELECT user_id, event_type, n, 0.0::DOUBLE AS tokens, us AS last, true AS ok, event_id FROM e WHERE n = 1 UNION ALL
    SELECT user_id, event_type, n, CASE WHEN have >= 1 THEN have - 1 ELSE tokens END, CASE WHEN have >= 1 THEN us ELSE last END, have >= 1, event_id FROM (
      SELECT e.user_id, e.event_type, e.n, e.us, e.event_id, r.tokens, r.last, least(1.0::DOUBLE, r.tokens + greatest(e.us - r.last, 0) / 1000000.0::DOUBLE * 0.00001::DOUBLE) AS have FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1))
    SELECT event_id FROM r WHERE ok""",
)
def _(spark, d):
    return stateful.token_bucket(events(spark, d), ["user_id", "event_type"], "at", "event_id", 0.00001, 1).select("event_id")


@query("breaker_failure_ratio", f"SELECT event_id, count(*) OVER w AS requests, count(*) FILTER (event_type = 'error') OVER w AS failures, count(*) OVER w >= 3 AND count(*) FILTER (event_type = 'error') OVER w >= count(*) OVER w * 0.5 AS tripped FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW)")
def _(spark, d):
    out = stateful.failure_ratio(events(spark, d), ["user_id"], "at", F.col("event_type") == "error", 24 * HOUR, 3, 0.5)
    return out.select("event_id", "requests", "failures", "tripped")


@query(
    "breaker_states",
    f"""WITH RECURSIVE e AS ({ORDERED}), r AS (
    SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS opened, []::STRUCT(t BIGINT, bad BOOLEAN)[] AS past, true AS admitted, 'closed' AS state, NULL::BIGINT AS event_id FROM (SELECT DISTINCT user_id FROM events) UNION ALL
    SELECT user_id, n,
      CASE WHEN refused THEN opened WHEN probe THEN CASE WHEN bad THEN us END WHEN trips THEN us END,
      CASE WHEN refused OR probe OR trips THEN []::STRUCT(t BIGINT, bad BOOLEAN)[] ELSE seen END, NOT refused,
      CASE WHEN refused THEN 'open' WHEN probe THEN CASE WHEN bad THEN 'open' ELSE 'closed' END WHEN trips THEN 'open' ELSE 'closed' END, event_id
    FROM (SELECT *, opened IS NOT NULL AND us - opened <= {12 * HOUR} AS refused, opened IS NOT NULL AND us - opened > {12 * HOUR} AS probe, len(seen) >= 3 AND len(list_filter(seen, lambda p: p.bad)) >= 0.5 * len(seen) AS trips
      FROM (SELECT e.user_id, e.n, e.event_id, e.us, e.event_type = 'error' AS bad, r.opened, list_filter(list_append(r.past, {{'t': e.us, 'bad': e.event_type = 'error'}}), lambda p: p.t >= e.us - {24 * HOUR}) AS seen FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
    SELECT event_id, admitted, state FROM r WHERE n > 0""",
)
def _(spark, d):
    ev = events(spark, d).withColumn("failed", F.col("event_type") == "error")
    return stateful.breaker(ev, ["user_id"], "at", "event_id", "failed", 24 * HOUR, 3, 0.5, 12 * HOUR).select("event_id", "admitted", "state")


@query(
    "fsm_fold",
    "WITH RECURSIVE rules(s, e, t) AS (VALUES "
    + ", ".join(f"('{s}', '{e}', '{t}')" for (s, e), t in SESSION.items())
    + f"), e AS ({ORDERED}), r AS (SELECT user_id, 0::BIGINT AS n, 'new' AS state, 0 AS moved, 0 AS refused FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.n, coalesce(rules.t, r.state), r.moved + (rules.t IS NOT NULL)::INT, r.refused + (rules.t IS NULL)::INT FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN rules ON rules.s = r.state AND rules.e = e.event_type) SELECT user_id, arg_max(state, n) AS state, max(moved)::INT AS moved, max(refused)::INT AS refused FROM r GROUP BY user_id",
)
def _(spark, d):
    return stateful.machine(events(spark, d), ["user_id"], "at", "event_id", "event_type", SESSION, "new")


@query("ttl_cache", f"SELECT p.event_id, CASE WHEN epoch_us(p.ts) < epoch_us(s.ts) + {12 * HOUR} THEN s.value END AS found FROM (SELECT * FROM events WHERE event_type <> 'view') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') s ON p.user_id = s.user_id AND p.ts >= s.ts")
def _(spark, d):
    ev = events(spark, d)
    sets = ev.where("event_type = 'view'").select("user_id", F.col("at").alias("set_at"), "value")
    return stateful.live_at(ev.where("event_type != 'view'"), sets, "user_id", "at", "set_at", "value", 12 * HOUR).select("event_id", "found")


@query("correlate", f"SELECT q.event_id, min(r.us) AS replied FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click') q LEFT JOIN (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') r ON q.user_id = r.user_id AND r.us >= q.us AND r.us < q.us + {6 * HOUR} GROUP BY q.event_id")
def _(spark, d):
    ev = events(spark, d)
    replies = ev.where("event_type = 'purchase'").select("user_id", F.col("at").alias("reply_at"))
    return stateful.correlate(ev.where("event_type = 'click'"), replies, "user_id", "at", "reply_at", 6 * HOUR).select("event_id", "replied")


@query(
    "tracked_calls",
    f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM (SELECT q.event_id, q.user_id, q.us, min(r.us) AS answer
      FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click') q LEFT JOIN (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') r ON q.user_id = r.user_id AND r.us >= q.us AND r.us < q.us + {24 * HOUR} GROUP BY ALL)),
    r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS opened, NULL::BIGINT AS closed, NULL::BIGINT AS event_id, NULL::BIGINT AS replied, '' AS outcome FROM (SELECT DISTINCT user_id FROM q) UNION ALL
    SELECT user_id, n, CASE WHEN dup THEN opened ELSE us END, CASE WHEN dup THEN closed ELSE answer END, event_id, CASE WHEN NOT dup THEN answer END, CASE WHEN dup THEN 'duplicate' WHEN answer IS NULL THEN 'timeout' ELSE 'answered' END
    FROM (SELECT q.*, r.opened, r.closed, coalesce(CASE WHEN r.closed IS NULL THEN q.us - r.opened < {24 * HOUR} ELSE q.us <= r.closed END, false) AS dup FROM r JOIN q ON q.user_id = r.user_id AND q.n = r.n + 1))
    SELECT event_id, replied, outcome FROM r WHERE n > 0""",
)
def _(spark, d):
    ev = events(spark, d)
    replies = ev.where("event_type = 'purchase'").select("user_id", F.col("at").alias("reply_at"))
    return stateful.tracked(ev.where("event_type = 'click'"), replies, "user_id", "at", "event_id", "reply_at", 24 * HOUR).select("event_id", "replied", "outcome")


@query(
    "adaptive_limit",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, 1000 + event_id * 7919 % 5000 AS rtt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), r AS (
    SELECT user_id, n, 11.0::DOUBLE AS lim, rtt AS smooth, rtt AS low, us AS since, event_id FROM e WHERE n = 1 UNION ALL
    SELECT user_id, n, CASE WHEN lim * (1 - low / smooth) > 5 THEN greatest(lim - 1, 1) WHEN lim * (1 - low / smooth) < 2 THEN least(lim + 1, 1000) ELSE lim END, smooth, low, since, event_id FROM (
      SELECT e.user_id, e.n, e.event_id, r.lim, trunc(0.9::DOUBLE * r.smooth + 0.1::DOUBLE * e.rtt)::BIGINT AS smooth, CASE WHEN e.us - r.since > {240 * HOUR} THEN e.rtt ELSE least(r.low, e.rtt) END AS low, CASE WHEN e.us - r.since > {240 * HOUR} THEN e.us ELSE r.since END AS since
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT event_id, lim AS "limit" FROM r""",
)
def _(spark, d):
    ev = events(spark, d).withColumn("rtt", 1000 + F.col("event_id") * 7919 % 5000)
    return stateful.adaptive_limit(ev, ["user_id"], "at", "event_id", "rtt", 10, forget=240 * HOUR).select("event_id", "limit")


@query(
    "backoff_decorrelated",
    """WITH RECURSIVE r AS (SELECT n_nationkey, 1 AS i, 100::BIGINT AS wait FROM nation UNION ALL
    SELECT n_nationkey, i + 1, 100 + floor(('0x' || left(md5(n_nationkey::VARCHAR || ':' || (i + 1)::VARCHAR), 8))::BIGINT / 4294967296.0::DOUBLE * (least(wait * 3, 5000) - 100))::BIGINT FROM r WHERE i < n_nationkey)
    SELECT n_nationkey, arg_max(wait, i) AS wait FROM r GROUP BY 1""",
)
def _(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", stateful.decorrelated(n, most=5000, seed=n).alias("wait"))


@query(
    "sample_interval",
    f"""WITH RECURSIVE e AS ({ORDERED}), r AS (
    SELECT user_id, n, us AS last, true AS ok, event_id FROM e WHERE n = 1 UNION ALL
    SELECT user_id, n, CASE WHEN go THEN us ELSE last END, go, event_id FROM (SELECT e.user_id, e.n, e.us, e.event_id, r.last, e.n - 1 < 2 OR (e.n - 1) % 10 = 0 OR e.us - r.last >= {24 * HOUR} AS go FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT event_id FROM r WHERE ok""",
)
def _(spark, d):
    return stateful.sometimes(events(spark, d), ["user_id"], "at", "event_id", first=2, every=10, interval=24 * HOUR).select("event_id")


@query("backoff_bounds", "SELECT n, raised::BIGINT AS raised, doubled::BIGINT AS doubled, half::BIGINT AS half FROM (VALUES (1, 500, 200, 50), (2, 500, 400, 100), (3, 500, 800, 200), (0, 500, 200, 50)) t(n, raised, doubled, half)")
def _(spark, d):
    n = F.col("n")
    full = stateful.delay("exponential", n, initial=50, most=10**6, jitter="full", seed=n)
    half = stateful.delay("exponential", n, initial=100, most=10**6, jitter="equal", seed=n)
    rows = spark.createDataFrame([(1,), (2,), (3,), (0,)], "n int")
    least = F.floor(stateful.delay("exponential", n, initial=100, most=10**6) / 2)
    return rows.where((full >= 0) & (full <= 50 * F.pow(F.lit(2.0), F.greatest(n, F.lit(1)) - 1)) & (half >= least) & (half <= 2 * least)).select("n", stateful.delay("exponential", n, initial=500, most=100).alias("raised"), stateful.delay("exponential", n, initial=200, factor=1.0).alias("doubled"), least.alias("half"))


@query("backoff_delays", "SELECT n_nationkey, floor(least(100 * pow(2.0, greatest(n_nationkey, 1) - 1), 30000))::BIGINT AS exponential, floor(least(100 + (greatest(n_nationkey, 1) - 1) * 250, 2000))::BIGINT AS linear, 100::BIGINT AS fixed FROM nation")
def _(spark, d):
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", stateful.delay("exponential", n).alias("exponential"), stateful.delay("linear", n, most=2000, step=250).alias("linear"), stateful.delay("constant", n).alias("fixed"))


@query("rfc3339_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", V.format_rfc3339(F.col("ts")).alias("text"))


@query("rfc3339_round_trip", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS at FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_micros(V.parse_rfc3339(V.format_rfc3339(F.col("ts")))).alias("at"))


@query("http_date", "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS text, epoch_us(date_trunc('second', ts)) AS back FROM events")
def _(spark, d):
    text = V.format_http_date(F.col("ts"))
    return table(spark, d, "events").select("event_id", text.alias("text"), F.unix_micros(V.parse_http_date(text)).alias("back"))


@query("time_range", "SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 2 DAY, INTERVAL 12 HOUR)) AS at FROM orders")
def _(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.explode(V.time_range(day, day + F.expr("INTERVAL 2 DAYS"), "12 HOURS")).alias("at"))


@query("ttl_normal", "SELECT o_orderkey, CASE WHEN (o_orderkey * 1000003) & 2147483648 <> 0 THEN 0 ELSE least(o_orderkey * 1000003, 604800) END AS ttl FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.normal_ttl(F.col("o_orderkey") * 1000003).alias("ttl"))


@query("epoch_timestamp", "SELECT event_id, CASE WHEN event_id <> 0 THEN event_id * 1000000 END AS at FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_micros(V.epoch_timestamp(F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"')))).alias("at"))


@query("session_last_extra", f"SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM ({ORDERED}))) GROUP BY user_id, s")
def _(spark, d):
    ev = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return ev.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "n")

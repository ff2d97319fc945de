"""Admission, expiry and state machines over event time, in batch.

The rules ask a clock where they run; here the clock is a column of microseconds, and rows are taken in the order
of that column and a tie-break. What depends on all that came before (admission rules, breakers, machines) is run
over rows dealt by key and sorted, in Arrow batches, with one small state for the key at hand: a key's rows pass
through one task, but are never held together, and the sort spills."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators import rules


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone; the session's zone should be UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_order(df: DataFrame, keys: list[str], at: str, tie: str, run: Callable, schema: str, *more: Column) -> DataFrame:
    """run(batches) over the columns of `df`, then key__ (the key as text) and `more`, sorted by key, `at` and `tie`, each key in one task."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key__")
    rows = df.select(*[f"`{c}`" for c in df.columns], key, *more)
    return rows.repartition("key__").sortWithinPartitions("key__", at, tie).mapInArrow(run, schema)


def starts(batch: pa.RecordBatch, last: str | None) -> list[bool]:
    """Whether each row begins another key than the row before it; `last` is the key before the batch."""
    key = batch.column(batch.schema.get_field_index("key__"))
    inside = pc.not_equal(key.slice(1), key.slice(0, batch.num_rows - 1)).to_pylist()
    return [key[0].as_py() != last, *inside]


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def admitted(df: DataFrame, keys: list[str], at: str, tie: str, rule) -> DataFrame:
    """The rows of `df` that a rule of tidewheel.operators.rules lets pass; a null clock counts as 0."""
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for new, now in zip(starts(batch, last), batch.column(width + 1).to_pylist(), strict=True):
                ok, state = rule.step(rule.first() if new else state, now)
                keep.append(ok)
            last = batch.column(width)[batch.num_rows - 1].as_py()
            yield batch.select(list(range(width))).filter(pa.array(keep))

    return in_order(df, keys, at, tie, run, ddl(df), F.coalesce(F.col(at).cast("bigint"), F.lit(0)).alias("now__"))


def throttle(df: DataFrame, keys: list[str], at: str, tie: str, interval: int) -> DataFrame:
    """Leading edge: a row passes if `interval` has gone by since the last that passed."""
    return admitted(df, keys, at, tie, rules.Throttle(interval))


def sliding_window(df: DataFrame, keys: list[str], at: str, tie: str, limit: int, window: int) -> DataFrame:
    """A row passes if fewer than `limit` rows passed in (now - window, now]; denied rows don't count."""
    return admitted(df, keys, at, tie, rules.SlidingWindow(limit, window))


def token_bucket(df: DataFrame, keys: list[str], at: str, tie: str, rate: float, burst: int, cost: int = 1) -> DataFrame:
    """A row passes if `cost` tokens are there; a bucket holds `burst`, starts full and gains `rate` a second. A denied row changes nothing, and time that runs backwards adds nothing."""
    return admitted(df, keys, at, tie, rules.TokenBucket(rate, burst, cost))


def sometimes(df: DataFrame, keys: list[str], at: str, tie: str, first: int = 0, every: int = 0, interval: int = 0) -> DataFrame:
    """The rows at which a call runs: a key's first, its first `first`, every `every`-th, and any once `interval` has gone by since the last that ran."""
    return admitted(df, keys, at, tie, rules.Sometimes(first, every, interval))


def debounce(df: DataFrame, keys: list[str], at: str, tie: str, interval: int) -> DataFrame:
    """Trailing edge: the last row before each quiet time of `interval`."""
    ahead = F.lead(at).over(Window.partitionBy(*keys).orderBy(at, tie))
    return df.withColumn("ahead__", ahead).where(F.coalesce(F.col("ahead__") - F.col(at) >= interval, F.lit(True))).drop("ahead__")


def failure_ratio(df: DataFrame, keys: list[str], at: str, failed: Column, window: int, least: int, threshold: float) -> DataFrame:
    """`df` with requests, failures and tripped over the trailing window, both edges included."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-window, 0)
    out = df.withColumns({"requests": F.count(F.lit(1)).over(w), "failures": F.count(F.when(failed, 1)).over(w)})
    return out.withColumn("tripped", (F.col("requests") >= least) & (F.col("failures") >= F.col("requests") * threshold))


def followed(df: DataFrame, keys: list[str], at: str, tie: str, rule, seen: Column, made: dict[str, str]) -> DataFrame:
    """`df` with the columns `made` (name to type: boolean, string or double) that a rule gives for each row's clock and `seen`; a null clock counts as 0."""
    width, kinds = len(df.columns), {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for new, now, x in zip(starts(batch, last), batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True):
                found, state = rule.step(rule.first() if new else state, (now, x))
                out.append(found)
            last = batch.column(width)[batch.num_rows - 1].as_py()
            more = [pa.array([x[i] for x in out], kinds[kind]) for i, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=[*batch.schema.names[:width], *made])

    schema = ", ".join([ddl(df), *[f"`{name}` {kind}" for name, kind in made.items()]])
    return in_order(df, keys, at, tie, run, schema, F.coalesce(F.col(at).cast("bigint"), F.lit(0)).alias("now__"), seen.alias("seen__"))


def breaker(df: DataFrame, keys: list[str], at: str, tie: str, failed: str, window: int, least: int, threshold: float, cooldown: int) -> DataFrame:
    """`df` with admitted and state after each call of a circuit breaker (rules.Breaker); a null `failed` is none."""
    rule = rules.Breaker(window, least, threshold, cooldown)
    return followed(df, keys, at, tie, rule, F.coalesce(F.col(failed), F.lit(False)), {"admitted": "boolean", "state": "string"})


def adaptive_limit(df: DataFrame, keys: list[str], at: str, tie: str, rtt: str, initial: int, most: int = 1000, forget: int = 30_000_000) -> DataFrame:
    """`df` with limit after each finished call (rules.Adaptive), `rtt` in whole microseconds."""
    return followed(df, keys, at, tie, rules.Adaptive(initial, most, forget), F.col(rtt).cast("bigint"), {"limit": "double"})


def live_at(probes: DataFrame, sets: DataFrame, key: str, at: str, set_at: str, value: str, ttl: int) -> DataFrame:
    """`probes` with found: the value last set at or before the probe, null if none or once now >= set + ttl.

    Both tables go through one window a key, so no pair of a probe and a set is ever made."""
    p = probes.withColumn("at__", F.col(at)).withColumn("set__", F.lit(None).cast("struct<t:bigint,v:" + sets.schema[value].dataType.simpleString() + ">")).withColumn("probe__", F.struct(*probes.columns))
    s = sets.select(F.col(key), F.col(set_at).alias("at__"), F.struct(F.col(set_at).alias("t"), F.col(value).alias("v")).alias("set__"))
    both = p.select(key, "at__", "set__", "probe__").unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("at__", F.col("probe__").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("last__", F.last("set__", ignorenulls=True).over(w)).where("probe__ is not null")
    return both.select("probe__.*", F.when(F.col("at__") < F.col("last__.t") + ttl, F.col("last__.v")).alias("found"))


def machine(df: DataFrame, keys: list[str], at: str, tie: str, event: str, rules: dict[tuple[str, str], str], initial: str) -> DataFrame:
    """keys, state, moved and refused after all events of a key in order; an event without a rule is refused."""
    small = df.select(*keys, F.col(at).alias("at__"), F.col(tie).alias("tie__"), F.col(event).alias("event__"))
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "state", "moved", "refused"]
        held, state, last = None, None, None

        def done(rows: list, states: list, types: list) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            kinds = (pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([s[i] for s in states], k) for i, k in enumerate(kinds)]], names=names)

        types: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [c.type for c in batch.columns[:width]]
            rows, states = [], []
            for i, (new, e) in enumerate(zip(starts(batch, last), batch.column(width + 2).to_pylist(), strict=True)):
                if new:
                    if held is not None:
                        rows.append(held)
                        states.append(state)
                    held, state = [c[i].as_py() for c in batch.columns[:width]], [initial, 0, 0]
                to = rules.get((state[0], e))
                state = [state[0], state[1], state[2] + 1] if to is None else [to, state[1] + 1, state[2]]
            last = batch.column(width + 3)[batch.num_rows - 1].as_py()
            if rows:
                yield done(rows, states, types)
        if held is not None:
            yield done([held], [state], types)

    return in_order(small, keys, "at__", "tie__", run, f"{ddl(df.select(*keys))}, state string, moved int, refused int")


def dot(rules: dict[tuple[str, str], str]) -> str:
    """The rule table as a graph description, one edge a rule, in order."""
    return "digraph {\n" + "".join(f'  "{s}" -> "{to}" [label="{e}"];\n' for (s, e), to in sorted(rules.items())) + "}\n"


def delay(kind: str, attempt: Column, initial: int = 100, most: int = 30_000, factor: float = 2.0, step: int = 100, jitter: str = "none", seed: Column | None = None) -> Column:
    """Milliseconds to wait before an attempt, counted from 1 (smaller ones count as 1): exponential, linear or constant.

    At most `most`, which is raised to `initial`; an initial or most of 0 or less and a factor of at most 1 count as
    their defaults. Jitter: full is uniform from 0 to the delay, equal from half of it to all of it; it is drawn from a
    hash of the column `seed` and the attempt, so reruns agree."""
    n = F.greatest(attempt, F.lit(1))
    initial, most, factor = initial if initial > 0 else 100, most if most > 0 else 30_000, factor if factor > 1 else 2.0
    raw = {"exponential": initial * F.pow(F.lit(factor), (n - 1).cast("double")), "linear": (initial + (n - 1) * step).cast("double"), "constant": F.lit(float(initial))}[kind]
    whole = F.least(raw, F.lit(float(max(most, initial))))
    if jitter != "none":
        drawn = F.pmod(F.xxhash64(seed if seed is not None else F.lit(0), n), F.lit(1 << 32)) / float(1 << 32)
        whole = {"full": whole * drawn, "equal": whole / 2 + whole / 2 * drawn}[jitter]
    return F.floor(whole)


def smoothed(value: str, order: str, keep: float = 0.9) -> Column:
    """Aggregate: exponentially weighted mean in order, keep * old + (1 - keep) * new, from the first value."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col(value).alias("value")))), lambda x: x["value"])
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.coalesce(a * keep + x * (1 - keep), x.cast("double")))


def correlate(requests: DataFrame, replies: DataFrame, key: str, at: str, reply_at: str, timeout: int) -> DataFrame:
    """`requests` with the time of the first reply of the same key within `timeout`, null if there is none.

    Both go through one window a key, latest first, so no pair of a request and a reply is ever made."""
    q = requests.select(F.col(key).alias("key__"), F.col(at).cast("bigint").alias("at__"), F.lit(None).cast("bigint").alias("reply__"), F.struct(*[f"`{c}`" for c in requests.columns]).alias("row__"))
    r = replies.select(F.col(key).alias("key__"), F.col(reply_at).cast("bigint").alias("at__"), F.col(reply_at).cast("bigint").alias("reply__"))
    w = Window.partitionBy("key__").orderBy(F.desc("at__"), F.col("reply__").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = q.unionByName(r, allowMissingColumns=True).withColumn("next__", F.last("reply__", ignorenulls=True).over(w)).where("row__ is not null")
    return both.select("row__.*", F.when(F.col("key__").isNotNull() & (F.col("next__") < F.col("at__") + timeout), F.col("next__")).alias("replied"))


def tracked(requests: DataFrame, replies: DataFrame, key: str, at: str, tie: str, reply_at: str, timeout: int, keep_alive: bool = False) -> DataFrame:
    """`requests` with replied as in correlate() and outcome: answered, timeout, or duplicate for an id still open.

    The first reply, or the timeout, frees the id; kept alive, it never is. A duplicate has no reply and opens nothing.
    At one instant a timeout comes before requests and these before replies. A null id is an id of its own, never answered."""
    found = followed(correlate(requests, replies, key, at, reply_at, timeout), [key], at, tie, rules.OneOpen(timeout, keep_alive), F.col("replied"), {"accepted": "boolean"})
    outcome = F.when(~F.col("accepted"), "duplicate").when(F.col("replied").isNull(), "timeout").otherwise("answered")
    return found.withColumn("outcome", outcome).withColumn("replied", F.when(F.col("accepted"), F.col("replied"))).drop("accepted")


def decorrelated(attempt: Column, initial: int = 100, most: int = 30_000, seed: Column | None = None) -> Column:
    """Milliseconds to wait before an attempt, each drawn between `initial` and thrice the one before, at most `most`.

    The first waits `initial`. Draws come from a digest of the column `seed` and the attempt, so reruns agree."""
    initial, most = initial if initial > 0 else 100, most if most > 0 else 30_000
    most, key = max(most, initial), (seed if seed is not None else F.lit("")).cast("string")

    def after(last: Column, i: Column) -> Column:
        drawn = F.conv(F.left(F.md5(F.concat_ws(":", key, i.cast("string"))), F.lit(8)), 16, 10).cast("bigint") / float(1 << 32)
        room = F.least(last * 3, F.lit(most).cast("bigint")) - initial
        return F.lit(initial).cast("bigint") + F.floor(drawn * F.greatest(room, F.lit(0)))

    first = F.lit(initial).cast("bigint")
    return F.when(attempt > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(attempt, F.lit(2)).cast("int")), first, after)).otherwise(first)

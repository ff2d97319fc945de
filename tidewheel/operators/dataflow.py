"""Ordered collection dataflow. Tables have no order, so every operator that needs one takes ordering columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def any_match(p: Column) -> Column:
    """Aggregate: does one row match? No rows, or only unknown predicates: false."""
    return F.coalesce(F.bool_or(F.coalesce(p, F.lit(False))), F.lit(False))


def all_match(p: Column) -> Column:
    """Aggregate: do all rows match? No rows: true."""
    return F.coalesce(F.bool_and(F.coalesce(p, F.lit(False))), F.lit(True))


def find_first(value: Column, p: Column, order: Column) -> Column:
    """Aggregate: the value of the first matching row; null if there is none."""
    return F.min_by(value, F.when(F.coalesce(p, F.lit(False)), order))


def take(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(max(n, 0))


def drop(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(max(n, 0))


def distinct_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; a partial limit keeps one row a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row__", F.row_number().over(w)).where("row__ = 1").drop("row__")


def index_last(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value of each key wins."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def collected(value: str, order: str) -> Column:
    """Aggregate: the values of a group as an array in order."""
    pairs = F.collect_list(F.struct(F.col(order).alias("order"), F.col(value).alias("value")))
    return F.transform(F.sort_array(pairs), lambda x: x["value"])


def fold(value: str, order: str, seed: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Aggregate: a sequential left fold in order; the step need not be associative."""
    return F.aggregate(collected(value, order), seed, step)


def unique_ordered(value: str, order: str) -> Column:
    """Aggregate: distinct values in the order of their first appearance."""
    return F.array_distinct(collected(value, order))


def chunked(df: DataFrame, size: int, partition: list[str], *order) -> DataFrame:
    """`df` with chunk, the number from 0 of the run of `size` rows a row lies in; a size under 1 leaves no rows."""
    if size <= 0:
        return df.withColumn("chunk", F.lit(0).cast("long")).limit(0)
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def chunk_array(a: Column, size: int) -> Column:
    """An array cut into runs of `size`; a size under 1 counts as 1."""
    n = max(size, 1)
    return F.when(F.size(a) == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.size(a), F.lit(n)), lambda i: F.slice(a, i, F.lit(n))))


def half_open(v: Column, start: Column, end: Column) -> Column:
    return (v >= start) & (v < end)


def stride(start: Column, end: Column, step: Column) -> Column:
    """The values from start up to, not including, end; a step under 1 gives none."""
    none = F.array().cast("array<bigint>")
    return F.when((step > 0) & (start < end), F.sequence(start.cast("long"), (end - 1).cast("long"), F.greatest(step, F.lit(1)).cast("long"))).otherwise(none)


def sometimes(df: DataFrame, partition: list[str], order: list, first: int = 0, every: int = 0) -> DataFrame:
    """The first call of each key, its first `first` calls and every `every`-th one, counted from 0."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    keep = (F.col("n__") == 0) | (F.col("n__") < first)
    if every > 0:
        keep = keep | (F.col("n__") % every == 0)
    return df.withColumn("n__", n).where(keep).drop("n__")


def round_robin(df: DataFrame, pool: list[str], order: list) -> DataFrame:
    """`df` with assigned: the pool's items in turn. Ranks come from counts of range partitions, so no task holds all rows."""
    ranked = ranks(df, order)
    return ranked.withColumn("assigned", F.element_at(F.array(*map(F.lit, pool)), (F.col("rank__") % len(pool) + 1).cast("int"))).drop("rank__")


def ranks(df: DataFrame, order: list) -> DataFrame:
    """`df` with rank__, each row's place from 0 in a global order without ties: rows are range partitioned, each partition ranks its own rows, and the partitions' counts (one row each) give the offsets."""
    from tidewheel.sources.shared import written

    parts = written(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1
    counts = {r.part__: r["count"] for r in parts.groupBy("part__").count().collect()}
    offsets, seen = {}, 0
    for p in sorted(counts):
        offsets[p] = seen
        seen += counts[p]
    at = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return parts.withColumn("rank__", own + F.element_at(at, F.col("part__").cast("long"))).drop("part__")


def set_intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return set_difference(a, b, keys).unionByName(set_difference(b, a, keys))


def batch_lookup(probes: DataFrame, table: DataFrame, key: str, value: str, missing: str = "missing") -> DataFrame:
    """Every probe with value, and error where its key is absent."""
    own = table.select(key, F.col(value).alias("value"), F.lit(True).alias("there__"))
    return probes.join(own, key, "left").withColumn("error", F.when(F.col("there__").isNull(), missing)).drop("there__")


def single_flight(df: DataFrame, key: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`df` with the columns of `call`, which sees each different key once."""
    return df.join(call(df.select(key).distinct()), key)


def recency(df: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """What a recency map of `capacity` holds after puts and hits in order: the keys used last, most recent first (position from 1)."""
    last = df.groupBy(key).agg(F.max(order).alias("used"))
    kept = last.orderBy(F.desc("used")).limit(capacity)
    return kept.withColumn("position", F.row_number().over(Window.orderBy(F.desc("used"))))

"""Prefix maps: longest stored prefix, keys under a prefix, ordered keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lengths(df: DataFrame, column: str) -> Column:
    """An array of the different lengths of a text column, found beforehand; there are no more than the longest text has characters."""
    found = [r.n for r in df.select(F.length(column).alias("n")).where("n is not null").distinct().collect()]
    return F.lit(sorted(found)) if found else F.array().cast("array<int>")


def longest_prefix(probes: DataFrame, probe: str, keys: DataFrame, key: str) -> DataFrame:
    """`probes` with found: the longest key that is a prefix of the probe, null if none is.

    The prefixes of each different probe, of those lengths that keys have, meet the keys in an equi-join, so no pair
    of tables is multiplied out and a long text has no more prefixes than there are lengths."""
    p = probes.select(probe).distinct().where(F.col(probe).isNotNull())
    each = p.select(probe, F.explode(F.transform(F.filter(lengths(keys, key), lambda n: n <= F.length(probe)), lambda n: F.substring(F.col(probe), F.lit(1), n))).alias("found"))
    hits = each.join(keys.select(F.col(key).alias("found")).distinct(), "found", "left_semi")
    best = hits.groupBy(probe).agg(F.max_by("found", F.length("found")).alias("found"))
    return probes.join(best, probe, "left")


def walk_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The rows under a prefix, in byte order; Parquet scans get the condition."""
    return df.where(F.col(key).startswith(prefix)).orderBy(key)


def has_prefix(probes: DataFrame, probe: str, keys: DataFrame, key: str) -> DataFrame:
    """`probes` with has: does a key start with the probe? The empty probe always has one."""
    k = keys.select(key).distinct()
    each = k.select(F.explode(F.transform(F.filter(lengths(probes, probe), lambda n: n <= F.length(key)), lambda n: F.substring(F.col(key), F.lit(1), n))).alias(probe)).distinct()
    hit = each.withColumn("has__", F.lit(True))
    return probes.join(hit, probe, "left").withColumn("has", F.coalesce("has__", F.col(probe) == "")).drop("has__")


def last_writes(df: DataFrame, key: str, value: str, order: str, removed: Column | None = None) -> DataFrame:
    """The map after inserts in order (the last wins); where the last operation is `removed`, the key is gone."""
    gone = F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)
    out = df.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v"), gone.alias("gone")), order).alias("x"))
    return out.where("not x.gone").select(key, F.col("x.v").alias(value))

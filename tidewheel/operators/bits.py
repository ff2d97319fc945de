"""Bit sets: small ones in one BIGINT, large ones as buckets of a few BIGINTs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def with_bit(x: Column, i: Column) -> Column:
    return x.bitwiseOR(bit(i))


def without_bit(x: Column, i: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(bit(i)))


def toggled(x: Column, i: Column) -> Column:
    return x.bitwiseXOR(bit(i))


def has_bit(x: Column, i: Column) -> Column:
    return x.bitwiseAND(bit(i)) != 0


def complement(x: Column, width: int) -> Column:
    """The complement within `width` bits, at most 63."""
    return F.bitwise_not(x).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def positions(x: Column, width: int = 63) -> Column:
    """The positions of set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: has_bit(x, i))


def next_set(x: Column, start: Column, width: int = 63) -> Column:
    """The first set position at or after start; -1 if there is none."""
    return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: has_bit(x, i) & (i >= start))), F.lit(-1))


def next_clear(x: Column, start: Column, width: int = 63) -> Column:
    return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ~has_bit(x, i) & (i >= start))), F.lit(-1))


def trailing_zeros(x: Column) -> Column:
    """Of a 64-bit value; 64 for 0."""
    return F.when(x == 0, 64).otherwise(F.bit_count(F.bitwise_not(x).bitwiseAND(x - F.lit(1).cast("long"))))


def leading_zeros(x: Column) -> Column:
    return F.when(x == 0, 64).when(x < 0, 0).otherwise(64 - F.length(F.bin(x)))


#: BIGINTs of a bucket.
WORDS = 8


def bitmap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bucket and bitmap: the set of whole values of each key in buckets of 512 bits, an array of WORDS BIGINTs;
    null values leave it empty.

    The words are aggregated as numbers in a hash table, before and after the shuffle, so rows need no sort and memory
    follows the buckets: bitmap_construct_agg sorts all rows of a task, and its 4 KB with few bits in them shrink in a
    shuffle, so that a task is dealt far more of them than it seems."""
    x = F.col(value).cast("bigint")
    word, own = F.shiftright(x, 6).bitwiseAND(F.lit(WORDS - 1).cast("bigint")), bit(x.bitwiseAND(F.lit(63).cast("bigint")))
    words = [F.coalesce(F.bit_or(F.when(word == i, own)), F.lit(0).cast("bigint")) for i in range(WORDS)]
    return df.groupBy(*keys, F.shiftright(x, 9).alias("bucket")).agg(F.array(*words).alias("bitmap"))


def cardinality(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    n = sum((F.bit_count(F.get("bitmap", F.lit(i))) for i in range(1, WORDS)), F.bit_count(F.get("bitmap", F.lit(0))))
    return bitmaps.groupBy(*keys).agg(F.sum(n).alias("n"))

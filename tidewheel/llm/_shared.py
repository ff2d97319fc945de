"""What several operators of this subpackage share: cut lineage, bounded broadcasts, word patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.sources.shared import written

#: A word: a longest run of bytes that are neither a space nor TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
__all__ = ["BROADCAST_BYTES", "HOT", "WORD", "ascii_lower", "beside", "column_list", "dealt_join", "hot_keys", "in_arrow", "mix64", "remainder", "sampled_labels", "slices_of", "small", "text_bytes", "without", "written"]

#: Bytes that may be broadcast at most; beyond this the same join runs shuffled. Rows of a key from which a join deals it out.
BROADCAST_BYTES, HOT = 32_000_000, 500
#: Bytes that an Arrow batch on its way to a worker should hold; Spark's own bound of 64 MB is too much beside a worker's tables.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lower-cased and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo `divisor`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def sampled_labels(labels: DataFrame, field: str, held_out: Column, bound: int) -> DataFrame:
    """At most about `bound` ids with a label of 0 or 1 from the rows that are not held out.

    Conflicting labels of an id: the larger. Which ids stay depends only on a hash of the id."""
    rows = labels.where(~held_out & F.col("doc_id").isNotNull() & F.col(field).isin(0, 1)).groupBy("doc_id").agg(F.max(field).cast("int").alias("label"))
    share = bound / max(1, labels.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    return rows


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (xor-shift and multiply steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices_of(batch: pa.RecordBatch, big: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose large column `big` holds about `most` bytes; a larger row stands alone."""
    if not batch.num_rows:
        return
    lengths = np.nan_to_num(pc.binary_length(batch.column(big)).to_numpy(zero_copy_only=False).astype(float)).cumsum()
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def column_list(df: DataFrame, keep: tuple[str, ...]) -> str:
    """The columns `keep` of `df` as a DDL schema."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded bytes: a session that hasn't set a bound of its own gets BATCH_BYTES."""
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def small(df: DataFrame) -> DataFrame:
    """`df`, best a written table, to be broadcast if all its rows together have at most BROADCAST_BYTES, else as it is."""
    size = F.lit(16 * len(df.columns) + 48 * sum(f.dataType.typeName() in ("struct", "array", "map") for f in df.schema))
    for f in df.schema:
        if f.dataType.simpleString() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def hot_keys(sizes: DataFrame, key: str) -> DataFrame | None:
    """The keys of `sizes` (key, n), a written table, with over HOT rows, and the number of parts to deal them over; None if there is none."""
    hot = sizes.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("parts__"))
    return None if hot.isEmpty() else small(hot)


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has one row for each `key`, where a key may have a third of all rows.

    The rows of a `hot` key are dealt over its parts by a hash of the column `by`; its row of `right` is repeated for each part."""
    if hot is None:
        return left.join(right, key, how)
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("parts__")).cast("int"), F.lit(0))
    left = left.join(hot, key, "left").withColumn("part__", part).drop("parts__")
    right = right.join(hot, key, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), F.coalesce("parts__", F.lit(1)) - 1))).drop("parts__")
    return left.join(right, [key, "part__"], how).drop("part__")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns of these names, which an operator's results take."""
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names])


def beside(keep: tuple[str, ...], column: str) -> Column:
    """`column` under a name that none of the kept ones has."""
    name = f"{column}__"
    while name.lower() in {k.lower() for k in keep}:
        name += "_"
    return F.col(column).alias(name)

"""Files as tables: listings, bounded whole-file reads, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def walk(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime and length of every file below a folder; `pattern` prunes the listing by name. No order."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "modificationTime", "length")


def whole_files(spark: SparkSession, folder: str, most: int, strict: bool = True) -> DataFrame:
    """path and content of each file of at most `most` bytes; a larger one is an error, or left out if not strict."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if not strict:
        return files.where(F.col("length") <= most).select("path", "content")
    checked = F.when(F.col("length") <= most, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("too large: "), F.col("path"))).cast("binary"))
    return files.select("path", checked.alias("content"))


def without_bom(content):
    """Binary content without a UTF-8 or UTF-16 byte-order mark; nothing is transcoded."""
    for mark in ("EFBBBF", "FEFF", "FFFE"):
        n = len(mark) // 2
        content = F.when(F.substring(content, 1, n) == F.unhex(F.lit(mark)), F.substring(content, n + 1, 2_000_000_000)).otherwise(content)
    return content


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Typed JSON lines, gzip by extension; a malformed line is an error, or nulls if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; readers see all of it or nothing, by the commit protocol."""
    df.write.mode("overwrite").option("compression", compression).json(path)

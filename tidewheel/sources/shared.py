"""Tables that cut the lineage of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one in a session of one local JVM without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """`df` computed once, written as Parquet in the shared folder and read again; executors may be lost meanwhile.

    The files go when the driver's Python ends, or with release()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewheel-{uuid.uuid4().hex}"
    remember(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """Have release() delete a path."""
    if not _written:
        atexit.register(release)
    _written.append((spark, path))


def release() -> None:
    """Delete what written() left in the shared folder."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; nothing can be deleted any more
            return

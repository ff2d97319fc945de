"""Run a stream over what its source holds now and give the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewheel.sources.shared import remember, shared_folder


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet table `name` of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(stream: DataFrame, timeout: int = 600) -> DataFrame:
    """All rows that a streaming DataFrame appends; files and progress lie in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/tidewheel-{uuid.uuid4().hex}"
    remember(spark, path)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"not drained after {timeout} seconds")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")

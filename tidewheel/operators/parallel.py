"""Parallel maps with an order or an error for each row, and keyed shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_in_order(df: DataFrame, order: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over Arrow batches in parallel; the result, which must keep `order`, comes in that order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema).orderBy(order)


def map_results(df: DataFrame, key: str, column: str, f: Callable, kind: str) -> DataFrame:
    """key, value and error for each row: what f gives, or the text of what it raises; nothing stops the others."""

    def one(x):
        try:
            return f(x), None
        except Exception as e:  # the error is the row's result
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [one(x) for x in batch[column]]
            yield pd.DataFrame({key: batch[key], "value": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    return df.select(key, column).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, value {kind}, error string")


def sharded(df: DataFrame, key: str, shards: int = 32) -> DataFrame:
    """Rows of a key together in one of `shards` partitions."""
    return df.repartition(shards, key)

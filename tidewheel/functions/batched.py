"""Arrow-batched functions whose types are parsed where a query is planned, not where a module is imported."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def batched(kind: str):
    """Make a function over pandas Series one over columns; workers may import its module without a session."""

    def wrap(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap

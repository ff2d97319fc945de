"""All queries by name and the equal SQL for DuckDB."""

from tidewheel.plans import codec_queries, flow_queries, state_queries, stream_queries, text_queries  # noqa: F401
from tidewheel.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (metric_queries, model_queries, state_queries,  # noqa: F401  (importing registers)
               stream_queries, stress_queries,
               table_queries, targets_queries)
from .catalog import QUERIES, tidy
from .monitor import monitor
from .specs import EVENTS, small

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    m = monitor(spark, folder, small(EVENTS, 10))
    return tidy(m.origins.select("stream_id", "origin", "y_tilde", "event", "risk_now",
                                 "risk_next", "eps"))

"""All registered queries of the motion-analytics operators, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionlake.plans import interval_queries, model_queries, points_queries, window_queries  # noqa: F401
from motionlake.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion energy, robust score, thresholds and label segments of each reference."""
    return QUERIES["a18_suggested_segments"](spark, sf_dir)

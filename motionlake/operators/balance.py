"""Balance of classes and sources: weights and duration budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times


def inverse_frequency(df: DataFrame, cells: Sequence[str], out: str = "weight") -> DataFrame:
    """rows / (cells * rows of the cell): counts of cells are aggregated first and joined back."""
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_cells"))
    weights = counts.crossJoin(F.broadcast(total)).select(*cells, (F.col("_rows") / (F.col("_cells") * F.col("_n"))).alias(out))  # one row
    return df.join(weights, list(cells))


def class_weights(df: DataFrame, target: str, explicit: dict[int, float] | None = None, out: str = "class_weight") -> DataFrame:
    """Balanced weights, or given ones."""
    if explicit is None:
        return inverse_frequency(df, [target], out)
    weight = F.lit(1.0)
    for value, w in explicit.items():
        weight = F.when(F.col(target) == value, w).otherwise(weight)
    return df.withColumn(out, weight)


def balance_by_duration(intervals: DataFrame, *, by: str, budget_s: float | Column, tie: Sequence[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Round-robin choice up to a budget of seconds: in each round the longest interval left of every reference,
    references with fewest chosen seconds first, until the budget is reached.

    Set-based: round = rank within the reference, prior = seconds of its earlier rounds; the global order is
    (round, prior, reference). Its running total comes from sums for each round and a window within the round.
    """
    own = Window.partitionBy(by).orderBy(F.desc("duration_s"), start, *tie)
    rows = intervals.withColumn("duration_s", times.seconds_between(start, stop)).withColumns({
        "round": F.row_number().over(own),
        "prior_s": F.coalesce(F.sum("duration_s").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    totals = rows.groupBy("round").agg(F.sum("duration_s").alias("_sum"))
    before = totals.select("round", F.coalesce(F.sum("_sum").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.coalesce(F.sum("duration_s").over(Window.partitionBy("round").orderBy("prior_s", by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = rows.join(before, "round").withColumn("total_before_s", F.col("_before") + inside).drop("_before")
    return placed.where(F.col("total_before_s") < budget_s)

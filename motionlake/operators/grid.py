"""Uniform grids: resampling, bounded interpolation, window centers, windows and their completeness.

All arithmetic is in integer micro-seconds. Bins start at midnight of a recording's first day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times

DAY_US = 86_400 * times.SECOND


def step_of(hz: float) -> int:
    """Bin width in micro-seconds: whole milliseconds."""
    return round(1000 / hz) * 1000


def bin_start(us: Column, origin_us: Column, step_us: int) -> Column:
    return (origin_us + F.floor((us - origin_us) / step_us) * step_us).cast("long")


def resample_mean(samples: DataFrame, *, keys: Sequence[str], signals: Sequence[str], step_us: int, time: str = "_time") -> DataFrame:
    """Mean of each signal in left-closed bins anchored at midnight of the first day of each key.

    Where the step divides a day all midnights give the same bins, and no second pass is needed.
    """
    us = times.micros(time)
    means = [F.avg(s).alias(s) for s in signals]
    if DAY_US % step_us == 0:
        rows = samples.withColumn("bin_us", bin_start(us, F.lit(0).cast("long"), step_us))
    else:
        first = samples.groupBy(*keys).agg((F.floor(F.min(us) / DAY_US) * DAY_US).cast("long").alias("_origin"))
        rows = samples.join(first, list(keys)).withColumn("bin_us", bin_start(us, F.col("_origin"), step_us))
    return rows.groupBy(*keys, "bin_us").agg(*means)


def uniform_grid(bounds: DataFrame, *, keys: Sequence[str], step_us: int, low: str = "low_us", high: str = "high_us") -> DataFrame:
    """All bins from low to high, both included; long spans are exploded by the hour first."""
    hour = max(3600 * times.SECOND // step_us, 1) * step_us
    blocks = bounds.where(F.col(low) <= F.col(high)).select(*keys, low, high, F.explode(F.sequence(F.col(low), F.col(high), F.lit(hour))).alias("_block"))
    stop = F.least(F.col("_block") + hour - step_us, F.col(high))
    return blocks.select(*keys, F.explode(F.sequence(F.col("_block"), stop, F.lit(step_us))).alias("bin_us"))


def on_grid(bins: DataFrame, *, keys: Sequence[str], signals: Sequence[str], step_us: int) -> DataFrame:
    """The bins of each key on its complete grid, with a mask of what was observed for each signal."""
    bounds = bins.groupBy(*keys).agg(F.min("bin_us").alias("low_us"), F.max("bin_us").alias("high_us"))
    full = uniform_grid(bounds, keys=keys, step_us=step_us).join(bins, [*keys, "bin_us"], "left")
    return full.withColumns({f"observed_{s}": F.col(s).isNotNull() for s in signals})


def interpolate_gaps(grid: DataFrame, signals: Sequence[str], *, keys: Sequence[str], limit: int | None, edges: bool = False, order: str = "bin_us", bucket_us: int = DAY_US) -> DataFrame:
    """Linear interpolation by row inside gaps, at most `limit` rows from the left of each; the rest stays null.

    A long gap is filled in part, on the line to its far end. Without a limit (none, zero or less) gaps are filled
    whole, and with `edges` the leading and trailing nulls take the nearest value. `order`, micro-seconds, is cut into
    buckets (of a day, or as wide as some 100,000 rows), so that windows never hold a long recording: what a bucket needs of those around it, its first
    row's number and the nearest values, comes from a row for each bucket.
    """
    bucket = [*keys, "_b"]
    cut = grid.withColumn("_b", F.floor(F.col(order) / bucket_us))
    ahead, back = (Window.partitionBy(*bucket).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, F.desc(order)))
    numbered = cut.withColumn("_n", F.row_number().over(Window.partitionBy(*bucket).orderBy(order)))
    seen = {s: F.when(F.col(s).isNotNull(), F.struct(F.col("_n").cast("long").alias("n"), F.col(s).cast("double").alias("v"))) for s in signals}
    made = {}
    for i, s in enumerate(signals):
        made |= {f"_l{i}": F.last(seen[s], ignorenulls=True).over(ahead), f"_r{i}": F.last(seen[s], ignorenulls=True).over(back)}
    near = numbered.withColumns(made)
    ends = [F.count(F.lit(1)).alias("_rows")]
    for i, s in enumerate(signals):
        ends += [F.max(seen[s]).alias(f"_last{i}"), F.min(seen[s]).alias(f"_first{i}")]  # by number
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = numbered.groupBy(*bucket).agg(*ends).withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["n"] + F.col("_start")).alias("n"), F.col(c)["v"].alias("v")))
    carried = {}
    for i in range(len(signals)):
        carried |= {f"_before{i}": F.last(at(f"_last{i}"), ignorenulls=True).over(before), f"_after{i}": F.last(at(f"_first{i}"), ignorenulls=True).over(after)}
    joined = near.join(buckets.withColumns(carried).select(*bucket, "_start", *carried), bucket)
    n = F.col("_start") + F.col("_n")
    out = {}
    for i, s in enumerate(signals):
        left, right = F.coalesce(at(f"_l{i}"), f"_before{i}"), F.coalesce(at(f"_r{i}"), f"_after{i}")
        line = left["v"] + (right["v"] - left["v"]) * (n - left["n"]) / (right["n"] - left["n"])
        inside = left.isNotNull() & right.isNotNull()
        if limit is not None and limit > 0:
            filled = F.when(inside & (n - left["n"] <= limit), line)
        else:
            filled = F.when(inside, line)
            if edges:
                filled = F.coalesce(filled, left["v"], right["v"])
        out[s] = F.coalesce(F.col(s), filled)
    return joined.withColumns(out).select(*grid.columns)


def window_centers(bounds: DataFrame, *, keys: Sequence[str], window_us: int, step_us: int, anchor_us: int | None = None, double_half: bool = True) -> DataFrame:
    """Centers of windows in [start_us, stop_us].

    Un-anchored, half a window is taken off each end twice (double_half), as extraction shrinks the common
    interval and the generator of centers shrinks it again; anchored, centers lie on the grid of the anchor, half a
    window inside.
    """
    half = window_us // 2
    trim = half if anchor_us is not None or not double_half else 2 * half
    first, last = F.col("start_us") + trim, F.col("stop_us") - trim
    if anchor_us is not None:
        first = F.lit(anchor_us) + F.ceil((first - anchor_us) / step_us) * step_us
    rows = bounds.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).where("_first <= _last")
    return rows.select(*keys, F.explode(F.sequence("_first", "_last", F.lit(step_us))).alias("center_us"))


def assemble_windows(samples: DataFrame, *, keys: Sequence[str], first_center: str, last_center: str, window_us: int, step_us: int, time_us: str = "bin_us") -> DataFrame:
    """Each sample in every window, closed on both ends, that covers it: its center and its place in the window.

    A sample finds its windows by arithmetic from the first and last center of its key; no range join.
    """
    half = window_us // 2
    t, first = F.col(time_us), F.col(first_center)
    low = F.greatest(F.ceil((t - first - half) / step_us), F.lit(0)).cast("long")
    high = F.least(F.floor((t - first + half) / step_us), F.floor((F.col(last_center) - first) / step_us)).cast("long")
    rows = samples.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    rows = rows.withColumn("_w", F.explode(F.sequence("_low", "_high"))).withColumn("center_us", F.col("_w") * step_us + first)
    return rows.withColumn("place_us", t - (F.col("center_us") - half)).drop("_low", "_high", "_w")


def completeness(windows: DataFrame, signals: Sequence[str], *, keys: Sequence[str], expected: int) -> DataFrame:
    """Share of observed samples of each window: the mean over signals of observed over expected rows, and its rows."""
    if not signals:
        share = F.lit(0.0)
    else:
        share = sum((F.sum(F.coalesce(F.col(f"observed_{s}").cast("int"), F.lit(0))) for s in signals), F.lit(0)) / (expected * len(signals))
    return windows.groupBy(*keys, "center_us").agg(F.count(F.lit(1)).alias("n_rows"), share.alias("completeness"))


def rejection_reasons(windows: DataFrame, *, by: Sequence[str], foot: str = "foot", least_rows: int, least: float) -> DataFrame:
    """Windows by the reason of the first failing foot (in foot order): empty, short, low_completeness, residual_null, ok.

    windows: n_rows, completeness and residual_nulls of each (by, center, foot).
    """
    reason = (
        F.when(F.col("n_rows") == 0, "empty")
        .when(F.col("n_rows") < least_rows, "short")
        .when(F.col("completeness") < least, "low_completeness")
        .when(F.col("residual_nulls") > 0, "residual_null")
    )
    first = F.min(F.when(reason.isNotNull(), F.struct(F.col(foot), reason.alias("reason"))))["reason"]
    each = windows.groupBy(*by, "center_us").agg(F.coalesce(first, F.lit("ok")).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n_windows"))


def spread_in_second(rows: DataFrame, *, keys: Sequence[str], time: str, order: str) -> DataFrame:
    """Times of second precision spread evenly: the i-th of n samples of a second gets i/n of it."""
    second = [*keys, time]
    rank = F.row_number().over(Window.partitionBy(*second).orderBy(order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*second))
    return rows.withColumn("spread_us", (times.micros(time) + F.floor(rank * times.SECOND / n)).cast("long"))

"""Automatic label suggestions from motion energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators import segments

#: Digits by which a score is compared with a threshold. The last digits of a mean depend on the order of rows; scores that
#: are equal but for those fall on one side.
DIGITS = 8


def motion_energy(samples: DataFrame, *, by: Sequence[str], value: str, time: str = "_time", window_us: int = times.SECOND) -> DataFrame:
    """Sample deviation (0 for a single sample) and samples of each key and window."""
    start = times.from_micros(F.floor(times.micros(time) / window_us) * window_us)
    return samples.withColumn("window_start", start).groupBy(*by, "window_start").agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("energy"), F.count(F.lit(1)).alias("samples"))


def robust_score(rows: DataFrame, *, by: Sequence[str], value: str, out: str = "score") -> DataFrame:
    """(x - median) / (1.4826 MAD) within the keys, below 0 as 0; MAD 0 falls back on mean and deviation, then on 0.

    One exchange by the keys serves all statistics. rows are windows, already aggregated, of a block.
    """
    w, x = Window.partitionBy(*by), F.col(value)
    near = rows.withColumns({"_med": F.percentile(value, F.lit(0.5)).over(w), "_avg": F.avg(value).over(w), "_std": F.stddev_pop(value).over(w)})
    near = near.withColumn("_mad", F.percentile(F.abs(x - F.col("_med")), F.lit(0.5)).over(w))
    z = F.when(F.col("_mad") > 0, (x - F.col("_med")) / (1.4826 * F.col("_mad"))).when(F.col("_std") > 0, (x - F.col("_avg")) / F.col("_std")).otherwise(0.0)
    return near.withColumn(out, F.greatest(z, F.lit(0.0))).drop("_med", "_avg", "_std", "_mad")


def motion_score(scored: DataFrame, *, by: Sequence[str], foot: str = "foot") -> DataFrame:
    """Mean score over feet, samples in all and feet of each window."""
    return scored.groupBy(*by, "window_start").agg(F.avg("score").alias("score"), F.sum("samples").alias("samples"), F.countDistinct(foot).alias("feet"))


def _limits(low_q: float, high_q: float) -> tuple[Column, Column, Column]:
    """Low and high quantile and maximum of the finite scores."""
    fine = F.when(F.abs("score") < float("inf"), F.col("score"))
    return F.percentile(fine, F.lit(low_q)), F.percentile(fine, F.lit(high_q)), F.max(fine)


def _high(low: str, high: str, most: str) -> Column:
    return F.when(F.col(high) <= F.col(low), F.col(most)).otherwise(F.col(high))


def thresholds(scores: DataFrame, *, by: Sequence[str], low_q: float = 0.35, high_q: float = 0.75) -> DataFrame:
    """Exact quantiles of the finite scores; a high one that is not above the low one becomes the maximum."""
    low, high, most = _limits(low_q, high_q)
    q = scores.groupBy(*by).agg(low.alias("low"), high.alias("_high"), most.alias("_max"))
    return q.withColumn("high", _high("low", "_high", "_max")).drop("_high", "_max")


def with_thresholds(scores: DataFrame, *, by: Sequence[str], low_q: float = 0.35, high_q: float = 0.75) -> DataFrame:
    """scores with low and high, in the exchange that brought them together."""
    low, high, most = (c.over(Window.partitionBy(*by)) for c in _limits(low_q, high_q))
    return scores.withColumns({"low": low, "_high": high, "_max": most}).withColumn("high", _high("low", "_high", "_max")).drop("_high", "_max")


def window_class(score: Column, low: Column, high: Column, ambiguous: bool = False) -> Column:
    """walking from the high threshold on, else not_walking up to the low one, else ambiguous or null; all to DIGITS."""
    score, low, high = (F.round(c, DIGITS) for c in (score, low, high))
    out = F.when(score >= high, lab.WALKING).when(score <= low, lab.NOT_WALKING)
    return out.otherwise("ambiguous") if ambiguous else out


def label_runs(classed: DataFrame, *, by: Sequence[str], window_us: int, least_s: float) -> DataFrame:
    """Segments of one label without a gap of more than 1.5 windows, as long as least_s at least."""
    rows = segments.gap_segments(classed.where("label is not null"), by=by, time="window_start", gap_us=int(1.5 * window_us), change=["label"], bucket_us=10_000 * window_us)
    found = rows.groupBy(*by, "segment").agg(
        F.min("label").alias("label"),
        F.min("window_start").alias("start"),
        times.from_micros(F.max(times.micros("window_start")) + window_us).alias("stop"),
        F.avg("score").alias("mean_score"),
        F.sum("samples").alias("samples"),
        F.min("feet").alias("feet_min"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    return found.withColumn("duration_s", times.seconds_between("start", "stop")).where(F.col("duration_s") >= least_s)


def suggest(samples: DataFrame, *, block: str, value: str, window_us: int, least_s: float, time: str = "_time") -> DataFrame:
    """Energy, robust score, thresholds and segments of each block in one plan."""
    energy = motion_energy(samples, by=[block, "foot"], value=value, time=time, window_us=window_us)
    score = motion_score(robust_score(energy, by=[block], value="energy"), by=[block])
    rows = with_thresholds(score, by=[block])
    rows = rows.withColumn("label", window_class(F.col("score"), F.col("low"), F.col("high")))
    return label_runs(rows, by=[block], window_us=window_us, least_s=least_s)


def block_summary(samples: DataFrame, scores: DataFrame, limits: DataFrame, runs: DataFrame, *, block: str) -> DataFrame:
    """Raw rows, windows, thresholds, segments of each class and status of each block."""
    raw = samples.groupBy(block).agg(F.count(F.lit(1)).alias("raw_rows"))
    windows = scores.groupBy(block).agg(F.count(F.lit(1)).alias("n_windows"))
    found = runs.groupBy(block).agg(F.count_if(F.col("label") == lab.WALKING).alias("walking_segments"), F.count_if(F.col("label") == lab.NOT_WALKING).alias("not_walking_segments"))
    rows = raw.join(windows, block, "left").join(limits, block, "left").join(found, block, "left").fillna(0, ["n_windows", "walking_segments", "not_walking_segments"])
    total = F.col("walking_segments") + F.col("not_walking_segments")
    return rows.withColumn("status", F.when(F.col("n_windows") == 0, "no_valid_windows").when(total == 0, "no_segments").otherwise("ok"))


def accept(suggestions: DataFrame, least_s: float, feet: int = 2) -> DataFrame:
    """Suggestions with a valid label, long enough and from enough feet, as label rows."""
    good = suggestions.where(F.col("label").isin(lab.WALKING, lab.NOT_WALKING) & (F.col("duration_s") >= least_s) & (F.col("feet_min") >= feet))
    return good.withColumns({"mov_type": F.col("label"), "label_quality": F.lit("auto"), "review_notes": F.concat(F.lit("auto score "), F.format_number("mean_score", 3))})


def import_template(template: DataFrame, *, zone: str, review_fallback: bool = False) -> DataFrame:
    """Labels from a filled template: the first non-empty of UTC and local fields, optionally of the review window;
    `valid` tells whether the label is known and start lies before stop."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))

    def bound(which: str) -> Column:
        found = [times.parse_mixed(text(f"label_{which}_utc")), times.parse_mixed(text(f"label_{which}_local"), zone)]
        if review_fallback:
            found.append(times.parse_mixed(text(f"review_{which}_utc")))
        return F.coalesce(*found)

    rows = template.withColumns({"start": bound("from"), "stop": bound("until"), "label": lab.normalized(F.col("mov_type"))})
    return rows.withColumn("valid", F.coalesce(F.col("label").isin(lab.WALKING, lab.NOT_WALKING) & (F.col("start") < F.col("stop")), F.lit(False)))


def labelling_template(blocks: DataFrame, blank: Sequence[str] = ("mov_type", "label_quality", "review_notes")) -> DataFrame:
    """Blocks with empty fields to fill in."""
    return blocks.select(*blocks.columns, *(F.lit("").alias(c) for c in blank if c not in blocks.columns))

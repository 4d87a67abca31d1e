"""Time-domain features of windows, pairs of feet and recordings."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times
from motionlake.operators import segments
from motionlake.sources import sinks

STATS = ("mean", "std", "min", "max", "median", "iqr", "ptp", "rms", "energy", "abs_mean", "zcr", "slope", "diff_mean", "diff_std", "diff_max")


def magnitude(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """sqrt(x^2 + y^2 + z^2) if all three components exist; otherwise the table as it is."""
    parts = [f"{prefix}{a}" for a in "xyz"]
    if not set(parts) <= set(df.columns):
        return df
    return df.withColumn(out, F.sqrt(sum((F.col(p) * F.col(p) for p in parts), F.lit(0.0))))


def time_features(windows: DataFrame, *, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Fifteen statistics of each window (population deviation; zero crossings of the centred signal)."""
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(order)
    x = F.col(value)
    rows = windows.where(x.isNotNull()).withColumns({"_i": (F.row_number().over(ordered) - 1).cast("double"), "_d": F.abs(x - F.lag(value).over(ordered)), "_c": x - F.avg(value).over(w)})
    rows = rows.withColumn("_z", (F.signum("_c") != F.signum(F.lag("_c").over(ordered))).cast("int"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.percentile(x, F.lit(0.5)).alias("median"),
        (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias("iqr"),
        (F.max(x) - F.min(x)).alias("ptp"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.sum(x * x).alias("energy"),
        F.avg(F.abs(x)).alias("abs_mean"),
        F.coalesce(F.avg("_z"), F.lit(0.0)).alias("zcr"),
        F.coalesce(F.regr_slope(x, F.col("_i")), F.lit(0.0)).alias("slope"),
        F.coalesce(F.avg("_d"), F.lit(0.0)).alias("diff_mean"),
        F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("diff_std"),
        F.coalesce(F.max("_d"), F.lit(0.0)).alias("diff_max"),
    )


def pair_features(pairs: DataFrame, *, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Correlation (0 if a side is constant), mean absolute, root mean square and deviation of the difference."""
    d = F.col(left) - F.col(right)
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    corr = F.covar_pop(left, right) / F.when(spread > 0, spread)
    return pairs.where(d.isNotNull()).groupBy(*keys).agg(
        F.when(corr.isNull() | F.isnan(corr), 0.0).otherwise(corr).alias("corr"),
        F.avg(F.abs(d)).alias("diff_abs_mean"),
        F.sqrt(F.avg(d * d)).alias("diff_rms"),
        F.stddev_pop(d).alias("diff_std"),
    )


def array_features(df: DataFrame, *, keys: Sequence[str], samples: str) -> DataFrame:
    """time_features of rows that hold their samples as an array."""
    return time_features(df.select(*keys, F.posexplode(samples).alias("_place", "_value")), keys=keys, value="_value", order="_place")


def _plateaus(samples: DataFrame, keys: Sequence[str], value: str, order: str, bucket: int, block: int = 100_000) -> DataFrame:
    """keys, _v, _at, _before, _after: each stretch of equal values with its middle place (of two the earlier) and the
    values on both sides, null at the ends. Recordings are cut into buckets, and their stretches into blocks."""
    known = samples.select(*keys, order, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    runs = segments.islands(known, F.col("_v"), by=keys, order=[order], out="_run", place="_i", bucket_us=bucket)
    level = runs.groupBy(*keys, "_run").agg(F.first("flag").alias("_v"), F.floor((F.min("_i") + F.max("_i")) / 2).alias("_at"))
    near = level.withColumn("_of", F.explode(F.sequence(F.floor((F.col("_run") - 1) / block), F.floor((F.col("_run") + 1) / block))))
    w = Window.partitionBy(*keys, "_of").orderBy("_run")
    return near.withColumns({"_before": F.lag("_v").over(w), "_after": F.lead("_v").over(w)}).where(F.floor(F.col("_run") / block) == F.col("_of")).drop("_of", "_run")


def _apart(peaks: DataFrame, keys: Sequence[str], distance: int, out: str) -> DataFrame:
    """`out`: the number of each peak's neighbourhood; peaks of different ones are at least `distance` places apart."""
    rows = segments.keyed(peaks, keys, F.floor(F.col("_at") / (1_000 * distance)))
    far = lambda a, b: F.col(a)["at"] - F.col(b)["at"] >= distance
    return segments.numbered(rows, far("_facts", "_before"), far("_first", "_carry"), order=["_at"], facts=F.struct(F.col("_at").alias("at")), out=out)


def distant_peaks(peaks: DataFrame, *, keys: Sequence[str], distance: int) -> DataFrame:
    """The peaks (keys, _at, _v) that stay if they have to be `distance` places apart: higher ones first, of equal ones the
    later.

    A peak that no higher one is near to stays, and takes those near to it away. What these leave undecided falls into
    small neighbourhoods, each settled as one list; peaks that rise one after the other, nearer than the distance, make
    the longest ones.
    """
    if distance <= 1:
        return peaks.select(*keys, "_at", "_v")
    path, kinds = sinks.scratch_path(peaks.sparkSession, "peaks"), peaks.select(*keys, "_at", "_v").schema
    peaks.select(*keys, "_at", "_v").write.parquet(path)  # few rows of a recording, read several times
    peaks = peaks.sparkSession.read.schema(kinds).parquet(path)
    rank = F.struct("_v", "_at")
    near = lambda of: Window.partitionBy(*keys, of).orderBy("_at").rangeBetween(1 - distance, distance - 1)
    first = _apart(peaks.select(*keys, "_at", "_v"), keys, distance, "_near")
    first = first.withColumn("_top", rank == F.max(rank).over(near("_near")))
    first = first.withColumn("_hit", F.max("_top").over(near("_near")))
    rest = _apart(first.where(~F.col("_hit")).select(*keys, "_at", "_v"), keys, distance, "_near")

    listed = rest.groupBy(*keys, "_near").agg(F.sort_array(F.collect_list(rank), asc=False).alias("_all"))
    free = lambda kept, x: ~F.exists(kept, lambda y: F.abs(y["_at"] - x["_at"]) < distance)
    settled = F.aggregate("_all", F.array().cast(listed.schema["_all"].dataType), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return first.where("_top").select(*keys, "_at", "_v").unionByName(listed.select(*keys, F.inline(settled)))


def peak_cadence(samples: DataFrame, *, keys: Sequence[str], value: str, order: str, hz: float | None = None, height: float = 0.6, distance: int = 20, bucket: int = segments.BUCKET_US) -> DataFrame:
    """keys, n_peaks, cadence (peaks a minute, 0 where no time passes): stretches of equal values that lie above both
    neighbours and reach mean + height * sample deviation, at least `distance` samples apart. A stretch counts at its
    middle; one at either end is none. order: a time, or a sample number at `hz`. Null and NaN values are no peaks."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    number = times.micros(order) / times.SECOND if hz is None else F.col(order) / hz
    facts = samples.groupBy(*keys).agg((F.avg(x) + height * F.stddev_samp(x)).alias("_least"), (F.max(number) - F.min(number)).alias("_seconds"))
    level = _plateaus(samples, keys, value, order, bucket).where((F.col("_v") > F.col("_before")) & (F.col("_v") > F.col("_after")))
    same = facts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_least")
    met = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    peaks = level.join(same, met).where(F.col("_v") >= F.col("_least")).select(*keys, "_at", "_v")
    found = distant_peaks(peaks, keys=keys, distance=distance).groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return facts.join(found, met, "left").select(*keys, n.alias("n_peaks"), F.when(F.col("_seconds") > 0, 60.0 * n / F.col("_seconds")).otherwise(0.0).alias("cadence"))


def recording_features(samples: DataFrame, *, keys: Sequence[str], value: str, time_us: str) -> DataFrame:
    """Duration and magnitude statistics of each recording (sample deviation)."""
    return samples.groupBy(*keys).agg(((F.max(time_us) - F.min(time_us)) / 1e6).alias("duration_s"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.count(F.lit(1)).alias("n_samples"))


def in_columns(features: DataFrame, *, keys: Sequence[str], name: Column, names: Sequence[str], stats: Sequence[str] = STATS) -> DataFrame:
    """One row for each key with columns {name}_{stat}."""
    rows = features.withColumn("_name", name)
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col(s))).alias(f"{n}_{s}") for n in names for s in stats))

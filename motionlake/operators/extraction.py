"""Spectrograms of requested time ranges: grid, bounded interpolation, windows common to both feet, spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators import grid, spectral
from motionlake.operators.coverage import FEET
from motionlake.operators.intervals import DAY_US, in_buckets


def requested(samples: DataFrame, requests: DataFrame, *, time: str = "_time", width_us: int = DAY_US) -> DataFrame:
    """Samples of the half-open ranges of requests (request_id, reference, start, stop), with the request's columns."""
    dealt = in_buckets(requests.where("start < stop"), "start", "stop", width_us)
    timed = samples.withColumn("_bucket", F.floor(times.micros(time) / width_us).cast("long"))
    return timed.join(dealt, ["reference", "_bucket"]).where((F.col(time) >= F.col("start")) & (F.col(time) < F.col("stop"))).drop("_bucket")


def spectrogram(
    samples: DataFrame,
    requests: DataFrame,
    *,
    signals: Sequence[str],
    step_us: int,
    window_us: int,
    hop_us: int,
    fs: float,
    fmax: float,
    limit: int | None,
    least: float = 0.0,
    feet: Sequence[str] = FEET,
    taper: str = "hann",
    detrend: str = "linear",
    scale: str = "db",
    double_half: bool = True,
) -> DataFrame:
    """request_id, reference, foot, center_us, signal, completeness, p_000 ...: a row for each whole window of each foot.

    samples: reference, foot, _time and the signals. Windows lie in the interval that both feet and the request share,
    and are closed on both ends; gaps of up to `limit` rows are filled; windows with less than `least` of their samples
    observed, or with a null left, go.
    """
    n = window_us // step_us + 1
    found = requested(samples, requests).where(F.col("foot").isin(*feet))
    keys = ["request_id", "reference", "foot"]
    bins = grid.resample_mean(found, keys=keys, signals=signals, step_us=step_us)
    filled = grid.interpolate_gaps(grid.on_grid(bins, keys=keys, signals=signals, step_us=step_us), signals, keys=keys, limit=limit, bucket_us=max(DAY_US, 100_000 * step_us))
    each = bins.groupBy("request_id", "foot").agg(F.min("bin_us").alias("low"), F.max("bin_us").alias("high"))
    common = each.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_feet"), F.max("low").alias("low"), F.min("high").alias("high")).where(F.col("n_feet") == len(feet))
    common = common.join(requests.select("request_id", "start", "stop"), "request_id")
    bounds = common.select("request_id", F.greatest("low", times.micros("start")).alias("start_us"), F.least("high", times.micros("stop")).alias("stop_us"))
    centers = grid.window_centers(bounds, keys=["request_id"], window_us=window_us, step_us=hop_us, double_half=double_half)
    ends = centers.groupBy("request_id").agg(F.min("center_us").alias("first_us"), F.max("center_us").alias("last_us"))
    windows = grid.assemble_windows(filled.join(ends, "request_id"), keys=keys, first_center="first_us", last_center="last_us", window_us=window_us, step_us=hop_us)
    enough = grid.completeness(windows, signals, keys=keys, expected=n).where((F.col("n_rows") == n) & (F.col("completeness") >= least)).drop("n_rows")
    arrays = spectral.window_arrays(windows, signals, keys=keys).join(enough, [*keys, "center_us"])
    spectra = spectral.power_spectrum(arrays, samples="samples", n=n, fs=fs, fmax=fmax, taper=taper, detrend=detrend, scale=scale).where("power is not null")
    return spectral.bins_to_columns(spectra.drop("samples"), len(spectral.frequencies(n, fs, fmax)))


def bundle_spectrogram(bundle: DataFrame, requests: DataFrame, *, signals: Sequence[str], label: str = lab.NOT_WALKING, least: float = 0.03, **how: object) -> DataFrame:
    """spectrogram of bundle rows (reference, foot, signal, sample_order, _time to the second, value), under one label.

    Samples of one second are spread evenly over it. A window that lacks a signal gets it with zero power.
    """
    spread = grid.spread_in_second(bundle, keys=["reference", "foot", "signal"], time="_time", order="sample_order").withColumn("_time", times.from_micros(F.col("spread_us")))
    wide = spread.groupBy("reference", "foot", "_time").agg(*(F.avg(F.when(F.col("signal") == s, F.col("value"))).alias(s) for s in signals))
    found = spectrogram(wide, requests, signals=signals, least=least, **how)
    names = [c for c in found.columns if c.startswith("p_")]
    keys = ["request_id", "reference", "foot", "center_us", "completeness"]
    whole = spectral.complete_signals(found.withColumn("power", F.array(*names)), signals, keys=keys, n_bins=len(names))
    return spectral.bins_to_columns(whole, len(names)).withColumn("mov_type", F.lit(label))

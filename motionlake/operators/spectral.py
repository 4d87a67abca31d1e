"""Power spectra of windows.

Detrending, taper and Fourier transform are linear, so they fold into one coefficient for each bin and sample:
power is a weighted sum of squares of two scalar products, one matrix product for each Arrow batch of windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

FLOOR = 1e-12


def taper_of(name: str, n: int) -> np.ndarray:
    """Periodic windows, and `hanning`, the symmetric one of plotted spectrograms."""
    t, u = 2 * np.pi * np.arange(n) / n, 2 * np.pi * np.arange(n) / max(n - 1, 1)
    return {"hann": 0.5 - 0.5 * np.cos(t), "hamming": 0.54 - 0.46 * np.cos(t), "boxcar": np.ones(n), "hanning": 0.5 - 0.5 * np.cos(u)}[name]


def frequencies(n: int, fs: float, fmax: float) -> list[float]:
    return [k * fs / n for k in range(n // 2 + 1) if k * fs / n <= fmax]


def coefficients(n: int, fs: float, fmax: float, taper: str = "hann", detrend: str = "linear") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Real and imaginary rows for each bin, and the factor of its power (one-sided density)."""
    w = taper_of(taper, n)
    bins = np.arange(len(frequencies(n, fs, fmax)))
    wave = np.exp(-2j * np.pi * np.outer(bins, np.arange(n)) / n) * w
    if detrend != "none":
        basis = np.vstack([np.ones(n), np.arange(n) - (n - 1) / 2.0])[: 2 if detrend == "linear" else 1]
        basis = basis / np.sqrt((basis**2).sum(1, keepdims=True))
        wave = wave - (wave @ basis.T) @ basis
    factor = np.full(len(bins), 2.0 / (fs * (w**2).sum()))
    factor[0] /= 2
    if n % 2 == 0 and len(bins) == n // 2 + 1:
        factor[-1] /= 2
    return wave.real, wave.imag, factor


def power_spectrum(windows: DataFrame, *, samples: str, n: int, fs: float, fmax: float, taper: str = "hann", detrend: str = "linear", scale: str = "db", out: str = "power") -> DataFrame:
    """`out`, an array of one value a bin up to fmax, of windows with `samples`, an array of n numbers.

    Windows of another length, or with a null, get a null.
    """
    re, im, factor = coefficients(n, fs, fmax, taper, detrend)
    kernel, bins = np.vstack([re, im]).T, len(factor)
    keep = [c for c in windows.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(samples)
            own = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), n), False).to_numpy(zero_copy_only=False)))
            flat = column.take(pa.array(own)).flatten()
            whole = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False)).reshape(-1, n).any(1)
            x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, n)[whole]
            waves = x @ kernel
            power = factor * (waves[:, :bins] ** 2 + waves[:, bins:] ** 2)
            if scale == "db":
                power = 10 * np.log10(power + FLOOR)
            there = np.zeros(batch.num_rows, bool)
            there[own[whole]] = True
            ends = np.concatenate([[0], np.cumsum(there) * bins]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there, False)), pa.array(power.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, out])

    schema = StructType([*(f for f in windows.schema.fields if f.name != out), StructField(out, ArrayType(DoubleType()))])
    return windows.mapInArrow(run, schema)


def magnitude_spectrogram(samples: DataFrame, *, keys: Sequence[str], value: str, index: str, fs: float, n: int = 256, overlap: int = 128, scale: str = "db") -> DataFrame:
    """keys, window (from 0), time_s (of its center), power (an array of n // 2 + 1 values) of each whole window of n
    samples; the next begins n - overlap later. `index` numbers the samples of a key from 0. Symmetric taper, no detrending.
    """
    step = n - overlap
    last, first = F.floor(F.col(index) / step), F.greatest(F.ceil((F.col(index) - n + 1) / step), F.lit(0))
    rows = samples.select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_v"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("window"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"])
    windows = rows.groupBy(*keys, "window").agg(values.alias("_samples"))
    found = power_spectrum(windows, samples="_samples", n=n, fs=fs, fmax=fs / 2, taper="hanning", detrend="none", scale=scale).where("power is not null")
    return found.select(*keys, "window", ((F.col("window") * step + n / 2) / fs).alias("time_s"), "power")


def bins_to_columns(spectra: DataFrame, n_bins: int, power: str = "power", freqs: Sequence[float] | None = None) -> DataFrame:
    """Columns p_000 ... (and f_000_hz ... if frequencies are given) in place of the array."""
    made = {f"p_{i:03d}": F.get(F.col(power), F.lit(i)) for i in range(n_bins)}
    if freqs is not None:
        made |= {f"f_{i:03d}_hz": F.lit(float(freqs[i])) for i in range(n_bins)}
    return spectra.withColumns(made).drop(power)


def complete_signals(spectra: DataFrame, signals: Sequence[str], *, keys: Sequence[str], n_bins: int, power: str = "power") -> DataFrame:
    """A row for each expected signal of each key; what is missing has zero power."""
    zero = F.array_repeat(F.lit(0.0), n_bins)
    found = spectra.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("signal", power))).alias("_p"))
    each = found.withColumn("signal", F.explode(F.array(*(F.lit(s) for s in signals))))
    return each.select(*keys, "signal", F.coalesce(F.try_element_at("_p", F.col("signal")), zero).alias(power))


def window_arrays(windows: DataFrame, signals: Sequence[str], *, keys: Sequence[str], order: str = "place_us") -> DataFrame:
    """One row for each window and signal: its values in time order."""
    stacked = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals))
    long = windows.select(*keys, "center_us", order, F.inline(stacked))
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, "v"))), lambda x: x["v"])
    return long.groupBy(*keys, "center_us", "signal").agg(values.alias("samples"))

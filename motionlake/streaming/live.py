"""Streaming forms of operators; each has a batch form whose result it repeats once data are complete."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from motionlake.functions.labels import NO_LABEL


def dedup_samples(samples: DataFrame, keys: Sequence[str], *, time: str = "_time", late: str = "10 minutes") -> DataFrame:
    """The first sample of each key within the watermark."""
    return samples.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def motion_energy(samples: DataFrame, *, by: Sequence[str], value: str, time: str = "_time", window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Sample deviation and samples of each tumbling window, once it is complete."""
    found = samples.withWatermark(time, late).groupBy(F.window(time, window), *by)
    out = found.agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("energy"), F.count(F.lit(1)).alias("samples"))
    return out.select(*by, F.col("window.start").alias("window_start"), "energy", "samples")


def sliding_statistics(samples: DataFrame, *, by: Sequence[str], value: str, time: str = "_time", size: str, slide: str, late: str) -> DataFrame:
    """Mean, deviation and extremes of half-open sliding windows (the batch windows are closed on both ends)."""
    out = samples.withWatermark(time, late).groupBy(F.window(time, size, slide), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*by, F.col("window.start").alias("window_start"), "n", "mean", "std", "min", "max")


def activity_sessions(samples: DataFrame, *, by: Sequence[str], time: str = "_time", gap: str, late: str) -> DataFrame:
    """Sessions that a longer gap parts; rows exactly one gap apart stay together."""
    out = samples.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return out.select(*by, "first", "last", "n")


def label_stream(samples: DataFrame, labels: DataFrame, *, on: str = "reference", time: str = "_time") -> DataFrame:
    """Each sample with the label of the interval around it; the static labels must not overlap within a reference."""
    l = labels.select(F.col(on).alias("_on"), "start", "stop", "label")  # noqa: E741
    met = samples.join(l, (samples[on] == l["_on"]) & (samples[time] >= l["start"]) & (samples[time] < l["stop"]), "left")
    return met.withColumn("label", F.coalesce("label", F.lit(NO_LABEL))).drop("_on", "start", "stop")


def live_coverage(samples: DataFrame, *, time: str = "_time", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counters of each reference and foot for update mode."""
    out = samples.withWatermark(time, late).groupBy(F.window(time, window), "reference", "foot").agg(F.count(F.lit(1)).alias("n_rows"), F.max(time).alias("last"))
    return out.select("reference", "foot", F.col("window.start").alias("window_start"), "n_rows", "last")


class _Hysteresis(StatefulProcessor):
    """Keeps rows whose state may still be set back, and the machine's counters, for each sequence. They are one value: each
    call for state is a round trip out of Python, for every sequence of every batch."""

    def __init__(self, hi: float, lo: float, k: int, m: int, key: str, time: str, tie: Sequence[str] = ()):
        self.hi, self.lo, self.k, self.m, self.key, self.time, self.tie = hi, lo, k, m, key, time, list(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", "on boolean, run int, us array<long>, p array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        frames = [pdf for pdf in rows if len(pdf)]
        if not frames:
            return
        on, run, us, p = self.machine.get() or (False, 0, [], [])
        held = [(pd.NaT if t is None else pd.Timestamp(t, unit="us"), x) for t, x in zip(us, p, strict=True)]
        new = pd.concat(frames)
        ended = bool(new["ends"].any())
        new = new[~new["ends"]].sort_values([self.time, *self.tie], kind="stable")
        out: list[tuple[Any, float, int]] = []
        for t, p in zip(new[self.time], new["probability"], strict=True):
            held.append((t, p))
            if on:
                run = run + 1 if p < self.lo else 0
                if run >= self.m:  # the last m rows are cleared
                    out += [(*x, 0) for x in held]
                    held, on, run = [], False, 0
                elif run == 0:
                    out += [(*x, 1) for x in held]
                    held = []
            else:
                run = run + 1 if p >= self.hi else 0
                if run >= self.k:  # the last k rows are set
                    out += [(*x, 1) for x in held]
                    held, on, run = [], True, 0
                elif run == 0:
                    out += [(*x, 0) for x in held]
                    held = []
        if ended:  # no later row sets these back
            out += [(*x, int(on)) for x in held]
            held, on, run = [], False, 0
        self.machine.update((on, run, [None if pd.isna(t) else pd.Timestamp(t).value // 1000 for t, _ in held], [float(x) for _, x in held]))
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), self.time: [x[0] for x in out], "probability": [x[1] for x in out], "state": pd.Series([x[2] for x in out], dtype="int32")})

    def close(self) -> None:
        pass


def live_hysteresis(samples: DataFrame, *, key: str, time: str, hi: float, lo: float, k: int, m: int, tie: Sequence[str] = (), end: str | None = None) -> DataFrame:
    """Hysteresis states in append mode: a row comes out once no later row can change its state, so up to k - 1 or
    m - 1 rows of a sequence are held back. samples: key, time, probability, in time order between batches. A row whose
    boolean column `end` is true has no state of its own: it ends its sequence and brings out what is held back."""
    kind = samples.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("at", TimestampType()), samples.schema["probability"], *StructType.fromDDL("state int").fields])
    ends = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = samples.select(key, F.col(time).alias("at"), "probability", ends.alias("ends"), *tie)  # a leading underscore would be lost on the way
    made = rows.groupBy(key).transformWithStateInPandas(_Hysteresis(hi, lo, k, m, key, "at", tie), outputStructType=schema, outputMode="Append", timeMode="None")
    return made.withColumnRenamed("at", time)

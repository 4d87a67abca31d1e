"""Run lengths over buckets, sweeps of conflicts, peaks with plateaus, window sizes."""

import random
import time
from datetime import datetime, timedelta
from itertools import groupby

import numpy as np
import pytest
from definitions import dropped_by_definition
from pyspark.sql import functions as F

from motionlake.operators import features, intervals, metrics, segments

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("width", [1, 3_600_000_000, 10**15])
def test_run_lengths_go_over_buckets(spark, width):
    rng = random.Random(1)
    data = []
    for ref in ("a", "b", None):
        flags = [f for _ in range(12) for f in [rng.choice([True, False, None])] * rng.choice([1, 2, 9, 40])]
        data += [(ref, i, T0 + timedelta(minutes=20 * i), f) for i, f in enumerate(flags)]
    data += [("whole", i, T0 + timedelta(minutes=20 * i), True) for i in range(100)]
    df = spark.createDataFrame(data, "reference string, i long, t timestamp, f boolean").repartition(4)
    if width == 1:
        df, data = df.where("i < 40"), [d for d in data if d[1] < 40]
    want = {}
    for ref, own in groupby(data, key=lambda d: d[0]):
        for _, run in groupby(own, key=lambda d: d[3]):
            run = list(run)
            want |= {(ref, d[1]): len(run) for d in run}
    out = segments.run_lengths(df, F.col("f"), by=["reference"], order=["t", "i"], bucket_us=width)
    assert {(r.reference, r.i): r.run_length for r in out.collect()} == want
    kept = segments.min_run(df, F.col("f"), 9, by=["reference"], order=["t", "i"], bucket_us=width)
    assert {(r.reference, r.i): r.kept for r in kept.collect()} == {(d[0], d[1]): int(bool(d[3]) and want[d[0], d[1]] >= 9) for d in data}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "_run" not in "".join(x for x in plan.splitlines() if "Exchange" in x)  # no row travels to its run


def test_min_run_sweep_over_buckets_equals_the_filter(spark):
    rng = random.Random(2)
    data = [(r, i, T0 + timedelta(hours=i), rng.choice([0.1, 0.1, 0.6, 0.9]), rng.choice([0, 1, None])) for r in "ab" for i in range(120)] + [("c", i, T0 + timedelta(hours=i), 0.9, 1) for i in range(50)]
    df = spark.createDataFrame(data, "reference string, i long, t timestamp, p double, y int")
    grid = [(t, k) for t in (0.5, 0.8) for k in (1, 2, 5, 40)]
    for width in (3 * 3_600_000_000, 10**15):
        got = {(r.threshold, r.min_run): (r.tp, r.fp, r.fn, r.tn) for r in metrics.sweep_min_run(df, "y", "p", grid, by=["reference"], order=["t", "i"], bucket_us=width).collect()}
        for t, k in grid:
            kept = segments.min_run(df, F.col("p") >= t, k, by=["reference"], order=["t", "i"]).where("y is not null").collect()
            assert got[t, k] == tuple(sum(r.y == y and r.kept == p for r in kept) for y, p in ((1, 1), (0, 1), (1, 0), (0, 0)))


def test_conflict_sweep_equals_its_definition():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 25)
        own = sorted((s, s + rng.randrange(1, 12), rng.choice("ab" if rng.random() < 0.5 else "abc")) for s in (rng.randrange(40) for _ in range(n)))
        got = intervals._sweep(*(np.array([x[k] for x in own]) for k in (0, 1)), np.array(["abc".index(x[2]) for x in own]))
        assert got.tolist() == dropped_by_definition(own)


def test_conflict_sweep_of_many_overlapping_intervals():
    rng = np.random.default_rng(4)
    start = np.sort(rng.integers(0, 10**6, 100_000))
    began = time.time()
    gone = intervals._sweep(start, start + rng.integers(10**6, 2 * 10**6, 100_000), rng.integers(0, 2, 100_000))
    assert time.time() - began < 60 and 0 < (~gone).sum() < 100_000


def test_conflicts_with_missing_bounds_and_labels(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    data = [("a", at(0), at(9), "x"), ("a", at(1), at(5), None), ("a", at(2), at(4), None), ("a", None, at(5), "y"), ("a", at(3), None, "y"), ("b", at(0), at(3), "x"), ("b", at(1), at(4), "y")]
    out = intervals.resolve_conflicts(spark.createDataFrame(data, "reference string, start timestamp, stop timestamp, label string"))
    assert sorted(((r.reference, r.start, r.stop, r.dropped) for r in out.collect()), key=str) == sorted([("a", at(0), at(9), False), ("a", at(1), at(5), True), ("a", at(2), at(4), True), ("a", None, at(5), False), ("a", at(3), None, False), ("b", at(0), at(3), True), ("b", at(1), at(4), False)], key=str)


def peaks_by_definition(x, distance, height=0.6):
    least = np.mean(x) + height * np.std(x, ddof=1)
    found, at = [], 0
    for v, run in groupby(x):
        n = len(list(run))
        if 0 < at and at + n < len(x) and x[at - 1] < v > x[at + n] and v >= least:
            found.append((v, at + (n - 1) // 2))
        at += n
    kept = []
    for v, i in sorted(found, reverse=True):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return len(kept)


def test_peaks_by_hand(spark):
    cases = {
        "ramp": ([1, 2, 2, 3, 1, 0, 0, 5, 0], 1, 2),  # a rising step is none
        "plateau": ([0, 0, 9, 9, 9, 0, 0], 1, 1),
        "edges": ([9, 9, 0, 0, 9, 9], 1, 0),
        "near": ([0, 5, 0, 6, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0], 3, 2),  # 7 takes 6 away, and 5 stays
        "ties": ([0, 5, 0, 5, 0, 0, 0, 0, 0, 0], 3, 1),
        "flat": ([1, 1, 1, 1], 1, 0),
    }
    data = [(name, i, float(v)) for name, (x, _, _) in cases.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "key string, i int, v double")
    for name, (x, distance, n) in cases.items():
        got = features.peak_cadence(df.where(F.col("key") == name), keys=["key"], value="v", order="i", hz=2.0, distance=distance).collect()
        assert [(r.n_peaks, r.cadence) for r in got] == [(n, 60.0 * n / ((len(x) - 1) / 2.0))], name
        assert n == peaks_by_definition(x, distance)


def test_peaks_equal_their_definition_over_buckets(spark):
    rng = random.Random(7)
    data = {k: [float(rng.choice([0, 1, 1, 2, 3, 3, 4])) if k % 2 else round(rng.gauss(0, 1), 1) for _ in range(rng.choice([1, 2, 30, 200]))] for k in range(24)}
    rows = [(k if k else None, T0 + timedelta(seconds=i), v) for k, x in data.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key int, t timestamp, v double").repartition(3)
    for bucket in (7_000_000, 10**15):
        got = {r.key or 0: (r.n_peaks, r.cadence) for r in features.peak_cadence(df, keys=["key"], value="v", order="t", distance=5, bucket=bucket).collect()}
        for k, x in data.items():
            n = peaks_by_definition(x, 5) if len(x) > 1 else 0
            assert got[k] == (n, pytest.approx(60.0 * n / (len(x) - 1) if len(x) > 1 else 0.0)), k


def test_window_sizes_from_one_pass(spark):
    data = [(T0 + timedelta(seconds=s), f) for s in (0, 5, 11, 12, 29, 31, 100) for f in ("Left", "Right", None)] + [(None, "Left")]
    df = spark.createDataFrame(data, "_time timestamp, foot string")
    got = {r.window_s: (r.distinct_centers, r.left_rows, r.right_rows) for r in metrics.window_sizes(df, [6, 10, 15]).collect()}
    assert got == {6: (6, 8, 7), 10: (5, 8, 7), 15: (4, 8, 7)}

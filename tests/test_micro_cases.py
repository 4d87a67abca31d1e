"""Small hand-made cases, one for each trap of the semantics."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from definitions import states_by_definition

from motionlake.functions import contracts, labels, times
from motionlake.operators import autolabel, balance, features, folds, grid, intervals, metrics, reshape, segments, spectral

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_gap_is_filled_in_part_and_edges_stay_null(spark):
    v = [None, 1.0, None, None, None, None, 6.0, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, bin_us long, v double")
    out = dict(rows(grid.interpolate_gaps(df, ["v"], keys=["k"], limit=2), "bin_us", "v"))
    assert [out[i] for i in range(8)] == [None, 1.0, 2.0, 3.0, None, None, 6.0, None]
    out = dict(rows(grid.interpolate_gaps(df, ["v"], keys=["k"], limit=None, edges=True), "bin_us", "v"))
    assert [out[i] for i in range(8)] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0]


def test_nearest_takes_the_earlier_of_two_equally_near(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(100))], "id long, reference string, t timestamp")
    right = spark.createDataFrame([(7, "a", at(9.6), 1.0), (8, "a", at(10.4), 2.0)], "rid long, reference string, t timestamp, v double")
    found = intervals.asof_nearest(left, right, on="t", key="id", tolerance_us=400_000, right_columns=["v"], tie="rid")
    assert rows(found, "id", "right_v") == [(1, 1.0)]
    assert intervals.asof_nearest(left, right, on="t", key="id", tolerance_us=399_999, right_columns=["v"], tie="rid").count() == 0


def test_overlapping_labels_and_interval_ends(spark):
    l = spark.createDataFrame([("a", at(0), at(20), "walking"), ("a", at(10), at(30), "not_walking")], "reference string, start timestamp, stop timestamp, label string")  # noqa: E741
    p = spark.createDataFrame([(i, "a", at(i)) for i in (0, 10, 19, 20, 30)], "id long, reference string, t timestamp")
    first = dict(rows(intervals.label_points(p, l, time="t"), "id", "label"))
    assert first == {0: "walking", 10: "walking", 19: "walking", 20: "not_walking", 30: "NO_LABEL"}
    last = dict(rows(intervals.label_points(p, l, time="t", overlap="last"), "id", "label"))
    assert last[10] == "not_walking" and last[0] == "walking"


def test_bucket_width_does_not_change_labels(spark):
    rng = random.Random(1)
    l = spark.createDataFrame([("a", at(s), at(s + rng.randint(1, 500)), f"l{i}") for i, s in enumerate(rng.sample(range(3000), 40))], "reference string, start timestamp, stop timestamp, label string")  # noqa: E741
    p = spark.createDataFrame([(i, "a", at(rng.random() * 3000)) for i in range(300)], "id long, reference string, t timestamp")
    found = [sorted(rows(intervals.label_points(p, l, time="t", width_us=w * times.SECOND), "id", "label")) for w in (7, 100, 86_400)]
    assert found[0] == found[1] == found[2]


def test_exclusion_is_closed_on_both_ends(spark):
    p = spark.createDataFrame([(i, "a", at(i)) for i in (9, 10, 20, 21)], "id long, reference string, _time timestamp")
    x = spark.createDataFrame([("a", at(10), at(20))], "reference string, start timestamp, stop timestamp")
    assert sorted(r[0] for r in rows(intervals.exclude_points(p, x), "id")) == [9, 21]


def test_gap_exactly_at_the_threshold_does_not_part(spark):
    df = spark.createDataFrame([("a", at(s)) for s in (0, 5, 10.000001)], "reference string, t timestamp")
    assert [r[0] for r in sorted(rows(segments.gap_segments(df, by=["reference"], time="t", gap_us=5_000_000), "segment"))] == [1, 1, 2]


def test_global_blocks_run_on_over_references(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(99)), ("b", at(0)), ("c", at(0)), ("c", at(99))], "reference string, t timestamp")
    out = segments.global_blocks(segments.gap_segments(df, by=["reference"], time="t", gap_us=5_000_000))
    assert sorted(r[0] for r in rows(out, "block_id")) == [0, 1, 2, 3, 4]


def test_transition_distance_only_at_the_change(spark):
    df = spark.createDataFrame([("a", at(i), x) for i, x in enumerate("wwwnn")], "k string, t timestamp, label string")
    out = dict(rows(segments.transition_distance(df, by=["k"], time="t", label="label"), "t", "nearest_transition_s"))
    assert [out[at(i)] for i in range(5)] == [None, None, 1.0, 1.0, None]


def test_run_at_the_end_and_runs_at_segment_borders(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([1, 0, 1, 1])] + [("b", i, p) for i, p in enumerate([1, 0])], "k string, i int, p int")
    out = {(k, i): x for k, i, x in rows(segments.min_run(df, F.col("p") == 1, 2, by=["k"], order=["i"]), "k", "i", "kept")}
    assert out == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("b", 0): 0, ("b", 1): 0}


def test_hysteresis_sets_and_clears_back():
    p = np.array([0.9, 0.1, 0.9, 0.9, 0.5, 0.1, 0.5, 0.1, 0.1, 0.9])
    assert states_by_definition(p, 0.8, 0.3, 2, 2) == [0, 0, 1, 1, 1, 1, 1, 0, 0, 0]


def test_robust_score_falls_back(spark):
    flat = [("flat", 1.0)] * 3
    mad0 = [("mad0", 0.0)] * 4 + [("mad0", 10.0)]
    out = rows(autolabel.robust_score(spark.createDataFrame(flat + mad0, "k string, v double"), by=["k"], value="v"), "k", "v", "score")
    assert {s for k, _, s in out if k == "flat"} == {0.0}
    assert max(s for k, _, s in out if k == "mad0") == pytest.approx(2.0)


def test_metrics_without_positives_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, h int")
    m = metrics.binary_metrics(df, "y", "h").collect()[0]
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert metrics.binary_metrics(df.limit(0), "y", "h").collect()[0].accuracy is None


def test_threshold_sweep_equals_direct_counts(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 1), rng.choice([None, rng.random()])) for _ in range(200)]
    grid_ = [0.2, 0.5, 0.9]
    s = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in metrics.sweep_threshold(spark.createDataFrame(data, "y int, p double"), "y", "p", grid_).collect()}
    for t in grid_:
        hit = [(y, p is not None and p >= t) for y, p in data]
        assert s[t] == (hit.count((1, True)), hit.count((0, True)), hit.count((1, False)), hit.count((0, False)))


def test_steps_that_do_not_divide_a_day_start_at_midnight(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 23, 59, 59, 990_000), 1.0), ("a", datetime(2024, 1, 2, 0, 0, 0, 5_000), 3.0)], "k string, _time timestamp, v double")
    step = grid.step_of(1000 / 33)
    assert step == 33_000
    origin = int(datetime(2024, 1, 1).timestamp()) * 1_000_000  # the session is UTC
    got = sorted(r[0] for r in rows(grid.resample_mean(df, keys=["k"], signals=["v"], step_us=step), "bin_us"))
    assert all((g - origin) % step == 0 for g in got)


def test_local_hours_around_a_clock_change(spark):
    df = spark.createDataFrame([("2024-10-27 02:30:00",), ("2024-03-31 03:30:00",), ("2024-07-01T12:00:00+02:00",), ("nonsense",)], "s string")
    got = [r[0] for r in rows(df.select(times.parse_mixed(F.col("s"), "Europe/Madrid").alias("t")), "t")]
    assert got == [datetime(2024, 10, 27, 0, 30), datetime(2024, 3, 31, 1, 30), datetime(2024, 7, 1, 10, 0), None]


def test_chained_conflicts(spark):
    data = [("a", at(0), at(10), "w"), ("a", at(5), at(12), "n"), ("a", at(11), at(13), "w")]
    out = dict(rows(intervals.resolve_conflicts(spark.createDataFrame(data, "reference string, start timestamp, stop timestamp, label string")), "start", "dropped"))
    assert out == {at(0): False, at(5): True, at(11): False}


def test_window_centers_shrink_twice_unless_anchored(spark):
    b = spark.createDataFrame([("a", 0, 10_000_000)], "k string, start_us long, stop_us long")
    get = lambda **how: [r[0] / 1e6 for r in sorted(rows(grid.window_centers(b, keys=["k"], window_us=2_000_000, step_us=1_000_000, **how), "center_us"))]
    assert get() == [2, 3, 4, 5, 6, 7, 8]
    assert get(anchor_us=500_000) == [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 8.5]


def test_windows_are_closed_on_both_ends(spark):
    s = spark.createDataFrame([("a", i * 10, 100, 300) for i in range(41)], "k string, bin_us long, f long, l long")
    w = grid.assemble_windows(s, keys=["k"], first_center="f", last_center="l", window_us=100, step_us=100)
    assert {r["center_us"]: r["count"] for r in w.groupBy("center_us").count().collect()} == {100: 11, 200: 11, 300: 11}


def test_spectrum_equals_the_transform(spark):
    n, fs = 101, 100.0
    x = np.random.default_rng(0).normal(size=n) + np.arange(n) * 0.1
    df = spark.createDataFrame([(x.tolist(),), (x[:-1].tolist(),)], "x array<double>")
    got = [r[0] for r in rows(spectral.power_spectrum(df, samples="x", n=n, fs=fs, fmax=5.0, scale="density"), "power")]
    t = np.arange(n)
    y = (x - np.polyval(np.polyfit(t, x, 1), t)) * spectral.taper_of("hann", n)
    p = np.abs(np.fft.rfft(y)) ** 2 * 2 / (fs * (spectral.taper_of("hann", n) ** 2).sum())
    p[0] /= 2
    assert got[0] == pytest.approx(p[:6].tolist(), rel=1e-9, abs=1e-18) and got[1] is None


def test_balanced_choice_equals_the_loop(spark):
    rng = random.Random(4)
    for seed in range(3):
        data = [(i, f"r{rng.randint(0, 3)}", at(i), at(i + rng.randint(1, 30))) for i in range(25)]
        budget = rng.randint(20, 150)
        left = {}
        for i, r, a, b in data:
            left.setdefault(r, []).append((-(b - a).total_seconds(), a, i))
        for v in left.values():
            v.sort()
        chosen, spent, total, turn = set(), dict.fromkeys(left, 0.0), 0.0, 0
        while total < budget and any(len(v) > turn for v in left.values()):
            for r in sorted((r for r in left if len(left[r]) > turn), key=lambda r: (spent[r], r)):
                if total >= budget:
                    break
                d, _, i = left[r][turn]
                chosen.add(i)
                spent[r] -= d
                total -= d
            turn += 1
        df = spark.createDataFrame(data, "id long, reference string, start timestamp, stop timestamp")
        assert {x[0] for x in rows(balance.balance_by_duration(df, by="reference", budget_s=float(budget), tie=["id"]), "id")} == chosen, seed


def test_folds_are_even_and_cover_all(spark):
    df = spark.range(101).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    out = folds.stratified_folds(df, target="y", key="id", k=4)
    per = out.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in per if r.y == y]
        assert len(n) == 4 and max(n) - min(n) <= 1


def test_halo_does_not_change_results(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, "a", at(i * 7 % 1000)) for i in range(300)], "id long, reference string, t timestamp").withColumn("us", times.micros("t"))
    w = lambda *k: Window.partitionBy(*k).orderBy("us").rangeBetween(-20_000_000, 20_000_000)
    whole = sorted(rows(df.withColumn("n", F.count("id").over(w("reference"))), "id", "n"))
    for bucket in (50, 300):
        cut = intervals.with_halo(df, "t", bucket * times.SECOND, 20 * times.SECOND).withColumn("n", F.count("id").over(w("reference", "bucket"))).where("not halo")
        assert sorted(rows(cut, "id", "n")) == whole


def test_contracts(spark):
    df = spark.createDataFrame([(1, "walking")], "target int, mov_type string")
    with pytest.raises(ValueError, match="missing columns: nothing"):
        contracts.require_columns(df, ["nothing"])
    with pytest.raises(ValueError, match="schemas differ"):
        reshape.union_keep_first({"a": df, "b": df.withColumn("target", F.lit("x"))})
    with pytest.raises(Exception, match="repeated key"):
        contracts.require_unique(df.unionByName(df), ["target"]).collect()
    assert contracts.require_unique(df, ["target"]).count() == 1
    assert contracts.numeric_features(df, ["mov_type"]) == ["target"]


def test_label_forms(spark):
    df = spark.createDataFrame([(" Walking ",), ("NOT WALKING",), ("",), (None,), ("jump",)], "s string")
    assert [r[0] for r in rows(df.select(labels.normalized(F.col("s")).alias("l")), "l")] == ["walking", "not_walking", None, None, "invalid:jump"]


def test_features_of_constant_and_short_windows(spark):
    df = spark.createDataFrame([("a", i, 2.0) for i in range(5)] + [("b", 0, 1.0)], "k string, i int, v double")
    out = {r.k: r for r in features.time_features(df, keys=["k"], value="v", order="i").collect()}
    assert (out["a"].std, out["a"].zcr, out["a"].slope, out["b"].diff_max) == (0.0, 0.0, 0.0, 0.0)
    pair = spark.createDataFrame([("a", 1.0, float(i)) for i in range(4)], "k string, l double, r double")
    assert features.pair_features(pair, keys=["k"], left="l", right="r").collect()[0].corr == 0.0


def test_segments_and_runs_cross_buckets(spark):
    """Numbers do not depend on how a recording is cut into time buckets."""
    import random

    rng = random.Random(8)
    data, us = [], 0
    for ref in ("a", "b", None):
        us = rng.randrange(10**12)
        for i in range(200):
            us += rng.choice((1, 1, 2, 9)) * 3_600_000_000
            data.append((ref, T0 + timedelta(microseconds=us), i, rng.random() < 0.6, rng.choice("xy")))
    df = spark.createDataFrame(data, "reference string, t timestamp, i long, f boolean, c string").repartition(5)
    want, runs = {}, {}
    for ref in ("a", "b", None):
        n = r = 0
        before = None
        for x in (x for x in data if x[0] == ref):
            n += before is None or (x[1] - before[1]).total_seconds() > 4 * 3600 or x[4] != before[4]
            r += before is None or x[3] != before[3]
            want[ref, x[2]], runs[ref, x[2]], before = n, r, x
    for width in (3_600_000_000, 86_400_000_000, 10**15):
        got = segments.gap_segments(df, by=["reference"], time="t", tie=["i"], gap_us=4 * 3_600_000_000, change=["c"], bucket_us=width)
        assert {(x.reference, x.i): x.segment for x in got.collect()} == want and set(got.columns) == {*df.columns, "segment"}
        got = segments.islands(df, F.col("f"), by=["reference"], order=["t", "i"], bucket_us=width)
        assert {(x.reference, x.i): x.run for x in got.collect()} == runs


def test_gaps_are_filled_across_buckets(spark):
    import random

    import numpy as np
    import pandas as pd

    rng = random.Random(9)
    step = 6 * 3_600_000_000
    values = [rng.random() if rng.random() < 0.3 else None for _ in range(120)]
    grid_ = spark.createDataFrame([("a", i * step, v, -(v or 0.0) if v is not None else None) for i, v in enumerate(values)], "reference string, bin_us long, v double, w double").repartition(4)
    s = pd.Series(values, dtype=float)
    for limit, edges in ((2, False), (None, False), (None, True)):
        got = grid.interpolate_gaps(grid_, ["v", "w"], keys=["reference"], limit=limit, edges=edges).orderBy("bin_us").collect()
        want = s.interpolate(limit=limit, limit_area="inside") if not edges else s.interpolate().bfill().ffill()
        assert np.allclose([np.nan if r.v is None else r.v for r in got], want, equal_nan=True), (limit, edges)
        assert all(r.w == (None if r.v is None else -r.v) for r in got)


def test_the_callers_session_stays(spark):
    from motionlake.plans import common

    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    own = common.session(other)
    assert other.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo" and own.conf.get("spark.sql.session.timeZone") == "UTC"
    assert common.session(other) is own and common.session(own) is own


def test_label_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("reference,datefrom,dateuntil,mov_type\nr2,2024-01-01 10:00:00,2024-01-01T11:00:00Z, walking \nr1,01/02/2024,2024-02-01 01:00,running\n")
    (tmp_path / "b.csv").write_text("reference,datefrom,dateuntil,mov_type\nr1,soon,2024-02-01 01:00,not_walking\n")
    from motionlake.sources import points

    got = points.read_labels(spark, [str(tmp_path / x) for x in ("a.csv", "b.csv")]).collect()
    assert [(r.reference, str(r.start), str(r.stop), r.label, r.source_file) for r in got] == [("r1", "None", "2024-02-01 01:00:00", "not_walking", "b.csv"), ("r2", "2024-01-01 10:00:00", "2024-01-01 11:00:00", "walking", "a.csv")]


def test_states_and_sequences_cross_buckets(spark):
    rng = random.Random(10)
    data = [(r, at(i * 1800), i, rng.choice([None, 0.1, 0.3, 0.35, 0.5, 0.6, 0.9])) for r in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(data, "reference string, t timestamp, i long, p double").repartition(3)
    for width in (3_600_000_000, 10**15):
        out = segments.hysteresis(df, "p", hi=0.5, lo=0.3, k=2, m=3, by=["reference"], order=["t", "i"], bucket_us=width)
        got = {(r.reference, r.i): r.state for r in out.collect()}
        for ref in "ab":
            assert [got[ref, i] for i in range(150)] == states_by_definition([v or 0.0 for r, _, _, v in data if r == ref], 0.5, 0.3, 2, 3)
    for block in (7, 100_000):
        s = segments.context_sequences(df, by=["reference"], order="t", features=["i", "p"], length=5, tie=["i"], block=block).collect()
        assert len(s) == 2 * 146
        for r in s:
            assert [x[0] for x in r.sequence] == [r.i + d for d in range(-2, 3)] and r.seq_start == at((r.i - 2) * 1800) and r.seq_stop == at((r.i + 2) * 1800)

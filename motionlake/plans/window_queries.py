"""Queries over coverage, energy, grids, windows, spectra, runs, reshaping and balance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators import autolabel, balance, coverage, features, grid, reshape, segments, selection, spectral
from motionlake.operators.intervals import with_halo
from motionlake.plans.common import EV, LB, PR, events, labels, predictions, query, table

DAY = 86_400 * times.SECOND
HOUR = 3_600 * times.SECOND


def _feet(spark, sf_dir):
    return events(spark, sf_dir).where("foot is not null")


_COV = "cv AS (SELECT reference, foot, count(*) AS n_rows, min(_time) AS first, max(_time) AS last FROM ev WHERE foot IS NOT NULL GROUP BY 1, 2)"


@query("a2_coverage", f"WITH {EV}, {_COV} SELECT * FROM cv")
def a2(spark, sf_dir):
    return coverage.coverage(_feet(spark, sf_dir), by=["reference"])


@query("a3_coverage_status", f"""WITH {EV}, {_COV}, w AS (SELECT reference, count(*) AS n_feet, greatest(min(first) FILTER (foot = 'Left'), min(first) FILTER (foot = 'Right')) AS a, least(max(last) FILTER (foot = 'Left'), max(last) FILTER (foot = 'Right')) AS b, CAST(sum(n_rows) AS BIGINT) AS total_rows FROM cv GROUP BY 1)
  SELECT reference, n_feet, CASE WHEN n_feet = 2 THEN a END AS common_start, CASE WHEN n_feet = 2 THEN b END AS common_stop, total_rows, CASE WHEN n_feet < 2 THEN 'only_some_feet' WHEN a >= b THEN 'no_common_interval' ELSE 'valid_both_feet' END AS status FROM w""")
def a3(spark, sf_dir):
    return coverage.coverage_status(coverage.coverage(_feet(spark, sf_dir), by=["reference"]), by=["reference"])


_INV = """iv AS (SELECT reference, count(*) FILTER (foot = 'Left') AS left_rows, min(_time) FILTER (foot = 'Left') AS left_first, max(_time) FILTER (foot = 'Left') AS left_last, count(*) FILTER (foot = 'Right') AS right_rows, min(_time) FILTER (foot = 'Right') AS right_first, max(_time) FILTER (foot = 'Right') AS right_last FROM ev WHERE foot IS NOT NULL GROUP BY 1),
  inv AS (SELECT *, left_rows + right_rows AS total_rows, left_rows > 0 AND right_rows > 0 AS valid_both_feet, CASE WHEN left_rows > 0 AND right_rows > 0 AND greatest(left_first, right_first) < least(left_last, right_last) THEN (epoch_us(least(left_last, right_last)) - epoch_us(greatest(left_first, right_first))) / 3600000000.0 ELSE 0.0 END AS common_hours FROM iv)"""


@query("a5_inventory", f"WITH {EV}, {_INV} SELECT * FROM inv", "common_hours")
def a5(spark, sf_dir):
    return coverage.inventory(_feet(spark, sf_dir))


_LS = "ls AS (SELECT reference, count(*) FILTER (label = 'walking') AS intervals_walking, coalesce(sum(epoch_us(stop) - epoch_us(start)) FILTER (label = 'walking'), 0) / 1000000.0 AS seconds_walking, count(*) FILTER (label = 'not_walking') AS intervals_not_walking, coalesce(sum(epoch_us(stop) - epoch_us(start)) FILTER (label = 'not_walking'), 0) / 1000000.0 AS seconds_not_walking, min(start) AS first_start, max(stop) AS last_stop FROM lb GROUP BY 1)"


@query("a6_label_summary", f"WITH {LB}, {_LS} SELECT *, intervals_walking > 0 AND intervals_not_walking > 0 AS has_both FROM ls", "seconds_walking seconds_not_walking")
def a6(spark, sf_dir):
    return coverage.label_summary(labels(spark, sf_dir))


def _candidates(spark, sf_dir):
    """Intervals that are not labelled as walking are to be looked at again."""
    return labels(spark, sf_dir).where("label = 'not_walking'").withColumn("priority", F.col("label_id") % 7)


@query("a7_candidate_summary", f"WITH {LB} SELECT reference, min(label_id % 7) AS best_priority, min(start) AS first_start, max(stop) AS last_stop, count(*) AS n_candidates FROM lb WHERE label = 'not_walking' GROUP BY 1")
def a7(spark, sf_dir):
    return coverage.candidate_summary(_candidates(spark, sf_dir))


_CLASS = f"""WITH {LB}, {_INV}, {_LS}, ca AS (SELECT reference, min(label_id % 7) AS best_priority, count(*) AS n_candidates FROM lb WHERE label = 'not_walking' GROUP BY 1),
  en AS (SELECT inv.reference, total_rows, valid_both_feet, common_hours, coalesce(intervals_walking, 0) AS w, coalesce(intervals_not_walking, 0) AS n, coalesce(n_candidates, 0) AS n_candidates, best_priority FROM inv LEFT JOIN ls USING (reference) LEFT JOIN ca USING (reference)),
  cl AS (SELECT *, CASE WHEN total_rows = 0 THEN 'no_data' WHEN NOT valid_both_feet THEN 'one_foot_only' WHEN w > 0 AND n > 0 THEN 'labelled_both_classes' WHEN w + n > 0 THEN 'labelled_one_class' WHEN n_candidates > 0 THEN 'candidate_to_label' ELSE 'unlabelled' END AS reference_class FROM en)"""


def _classified(spark, sf_dir):
    summary = coverage.label_summary(labels(spark, sf_dir))
    return coverage.classify_references(coverage.enrich(coverage.inventory(_feet(spark, sf_dir)), summary, coverage.candidate_summary(_candidates(spark, sf_dir))))


@query("j16_enriched_inventory", f"{_CLASS} SELECT reference, w AS intervals_walking, n AS intervals_not_walking, w > 0 AND n > 0 AS has_both, best_priority, n_candidates FROM cl")
def j16(spark, sf_dir):
    return _classified(spark, sf_dir).select("reference", "intervals_walking", "intervals_not_walking", "has_both", "best_priority", "n_candidates")


@query("a8_reference_class", f"{_CLASS} SELECT reference, reference_class, CASE reference_class WHEN 'labelled_both_classes' THEN 'use for training' WHEN 'labelled_one_class' THEN 'label the other class' WHEN 'candidate_to_label' THEN 'label candidates' WHEN 'one_foot_only' THEN 'check the sensor' WHEN 'no_data' THEN 'ignore' ELSE 'find candidate intervals' END AS action FROM cl")
def a8(spark, sf_dir):
    return _classified(spark, sf_dir).select("reference", "reference_class", "action")


@query("t3_priority_order", f"{_CLASS} SELECT reference, reference_class, common_hours, row_number() OVER (ORDER BY reference_class, common_hours DESC NULLS LAST, reference) AS place FROM cl", "common_hours")
def t3(spark, sf_dir):
    rows = selection.priority_order(_classified(spark, sf_dir)).select("reference", "reference_class", "common_hours")
    order = Window.orderBy(F.asc("reference_class"), F.desc_nulls_last("common_hours"), "reference")  # a row for each reference
    rounded = F.floor(F.col("common_hours") * 1e6 + 0.5) / 1e6  # halves by the number itself, not by its decimal text
    return rows.withColumn("place", F.row_number().over(order)).withColumn("common_hours", rounded)


@query("a9_candidate_kind", f"WITH {LB}, {_LS}, k AS (SELECT reference, CASE WHEN intervals_walking > 0 AND intervals_not_walking > 0 THEN 'both_classes' WHEN intervals_not_walking > 0 THEN 'only_not_walking' WHEN intervals_walking > 0 THEN 'only_walking' ELSE 'no_labels' END AS candidate_kind FROM ls) SELECT *, CASE candidate_kind WHEN 'both_classes' THEN 1 WHEN 'only_not_walking' THEN 2 WHEN 'only_walking' THEN 3 ELSE 4 END AS candidate_priority FROM k")
def a9(spark, sf_dir):
    return coverage.candidate_kind(coverage.label_summary(labels(spark, sf_dir))).select("reference", "candidate_kind", "candidate_priority")


_BINS = "bi AS (SELECT reference, epoch_us(time_bucket(INTERVAL 12 HOUR, _time, TIMESTAMP '1970-01-01')) AS bin_us, avg(value) AS v FROM ev GROUP BY 1, 2)"


def _bins(spark, sf_dir):
    return grid.resample_mean(events(spark, sf_dir).withColumnRenamed("value", "v"), keys=["reference"], signals=["v"], step_us=12 * HOUR)


@query("a10_resample", f"WITH {EV}, {_BINS} SELECT * FROM bi", "v")
def a10(spark, sf_dir):
    return _bins(spark, sf_dir)


@query("a10_resample_anchored", f"WITH {EV}, o AS (SELECT reference, epoch_us(date_trunc('day', min(_time))) AS origin FROM ev GROUP BY 1) SELECT reference, origin + (epoch_us(_time) - origin) // 25200000000 * 25200000000 AS bin_us, avg(value) AS v FROM ev JOIN o USING (reference) GROUP BY 1, 2", "v")
def a10b(spark, sf_dir):
    """Bins of seven hours do not divide a day: they are anchored at each reference's first midnight."""
    return grid.resample_mean(events(spark, sf_dir).withColumnRenamed("value", "v"), keys=["reference"], signals=["v"], step_us=7 * HOUR)


_GRID = f"{_BINS}, bo AS (SELECT reference, min(bin_us) AS lo, max(bin_us) AS hi FROM bi GROUP BY 1), gr AS (SELECT reference, unnest(range(lo, hi + 1, 43200000000)) AS bin_us FROM bo), og AS (SELECT gr.*, v, v IS NOT NULL AS observed_v FROM gr LEFT JOIN bi USING (reference, bin_us))"


@query("r9_uniform_grid", f"WITH {EV}, {_GRID} SELECT * FROM og", "v")
def r9(spark, sf_dir):
    return grid.on_grid(_bins(spark, sf_dir), keys=["reference"], signals=["v"], step_us=12 * HOUR)


_FILLED = """n AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY bin_us) AS i FROM og),
  e AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS li, last_value(v IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ri, first_value(v IGNORE NULLS) OVER a AS rv FROM n
    WINDOW b AS (PARTITION BY reference ORDER BY bin_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY reference ORDER BY bin_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w13_interpolate_gaps", f"WITH {EV}, {_GRID}, {_FILLED} SELECT reference, bin_us, observed_v, coalesce(v, CASE WHEN i - li <= 1 AND ri IS NOT NULL THEN lv + (rv - lv) * (i - li) / (ri - li) END) AS v FROM e", "v")
def w13(spark, sf_dir):
    return grid.interpolate_gaps(grid.on_grid(_bins(spark, sf_dir), keys=["reference"], signals=["v"], step_us=12 * HOUR), ["v"], keys=["reference"], limit=1, bucket_us=10 * DAY).select("reference", "bin_us", "observed_v", "v")


_CENTERS = "ce AS (SELECT reference, min(bin_us) + 259200000000 AS first_us, max(bin_us) - 259200000000 AS last_us FROM og GROUP BY 1), cc AS (SELECT reference, unnest(range(first_us, last_us + 1, 86400000000)) AS center_us FROM ce WHERE first_us <= last_us)"


def _centers(spark, sf_dir):
    on = grid.on_grid(_bins(spark, sf_dir), keys=["reference"], signals=["v"], step_us=12 * HOUR)
    bounds = on.groupBy("reference").agg(F.min("bin_us").alias("start_us"), F.max("bin_us").alias("stop_us"))
    return on, grid.window_centers(bounds, keys=["reference"], window_us=3 * DAY, step_us=DAY)


@query("r10_window_centers", f"WITH {EV}, {_GRID}, {_CENTERS} SELECT * FROM cc")
def r10(spark, sf_dir):
    return _centers(spark, sf_dir)[1]


@query("r10_anchored_centers", f"WITH {EV}, {_GRID}, b AS (SELECT reference, min(bin_us) + 129600000000 AS a, max(bin_us) - 129600000000 AS z FROM og GROUP BY 1), f AS (SELECT reference, z, CAST(ceil((a - 21600000000) / 86400000000.0) AS BIGINT) * 86400000000 + 21600000000 AS a FROM b) SELECT reference, unnest(range(a, z + 1, 86400000000)) AS center_us FROM f WHERE a <= z")
def r10b(spark, sf_dir):
    on = grid.on_grid(_bins(spark, sf_dir), keys=["reference"], signals=["v"], step_us=12 * HOUR)
    bounds = on.groupBy("reference").agg(F.min("bin_us").alias("start_us"), F.max("bin_us").alias("stop_us"))
    return grid.window_centers(bounds, keys=["reference"], window_us=3 * DAY, step_us=DAY, anchor_us=6 * HOUR)


def _windows(spark, sf_dir):
    on, centers = _centers(spark, sf_dir)
    ends = centers.groupBy("reference").agg(F.min("center_us").alias("first_us"), F.max("center_us").alias("last_us"))
    filled = grid.interpolate_gaps(on, ["v"], keys=["reference"], limit=2, bucket_us=10 * DAY)
    return grid.assemble_windows(filled.join(ends, "reference"), keys=["reference"], first_center="first_us", last_center="last_us", window_us=3 * DAY, step_us=DAY)


_WIN = f"{_GRID}, {_CENTERS}, {_FILLED}, fi AS (SELECT reference, bin_us, observed_v, coalesce(v, CASE WHEN i - li <= 2 AND ri IS NOT NULL THEN lv + (rv - lv) * (i - li) / (ri - li) END) AS v FROM e), wi AS (SELECT cc.reference, cc.center_us, fi.bin_us - (cc.center_us - 129600000000) AS place_us, observed_v, v FROM cc JOIN fi ON fi.reference = cc.reference AND fi.bin_us BETWEEN cc.center_us - 129600000000 AND cc.center_us + 129600000000)"


@query("j22_assemble_windows", f"WITH {EV}, {_WIN} SELECT * FROM wi", "v")
def j22(spark, sf_dir):
    return _windows(spark, sf_dir).select("reference", "center_us", "place_us", "observed_v", "v")


@query("a11_completeness", f"WITH {EV}, {_WIN} SELECT reference, center_us, count(*) AS n_rows, count(*) FILTER (observed_v) / 7.0 AS completeness FROM wi GROUP BY 1, 2", "completeness")
def a11(spark, sf_dir):
    return grid.completeness(_windows(spark, sf_dir), ["v"], keys=["reference"], expected=7)


@query("a12_rejection_reasons", f"""WITH {EV}, {_WIN}, s AS (SELECT reference, center_us, count(*) AS n, count(*) FILTER (observed_v) / 7.0 AS c, count(*) FILTER (v IS NULL) AS r FROM wi GROUP BY 1, 2)
  SELECT CASE WHEN n < 7 THEN 'short' WHEN c < 0.6 THEN 'low_completeness' WHEN r > 0 THEN 'residual_null' ELSE 'ok' END AS reason, count(*) AS n_windows FROM s GROUP BY 1""")
def a12(spark, sf_dir):
    w = _windows(spark, sf_dir)
    stats = grid.completeness(w, ["v"], keys=["reference"], expected=7).join(w.groupBy("reference", "center_us").agg(F.count_if(F.col("v").isNull()).alias("residual_nulls")), ["reference", "center_us"])
    return grid.rejection_reasons(stats.withColumn("foot", F.lit("Left")), by=["reference"], least_rows=7, least=0.6)


@query("f4_window_features", f"WITH {EV}, {_WIN}, c AS (SELECT reference, center_us FROM wi GROUP BY 1, 2 HAVING count(v) = 7) SELECT reference, center_us, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS ptp, quantile_cont(v, 0.5) AS median FROM wi JOIN c USING (reference, center_us) GROUP BY 1, 2", "mean std ptp median")
def f4(spark, sf_dir):
    w = _windows(spark, sf_dir)
    whole = w.groupBy("reference", "center_us").agg(F.count("v").alias("_n")).where("_n = 7").drop("_n")
    out = features.time_features(w.join(whole, ["reference", "center_us"]), keys=["reference", "center_us"], value="v", order="place_us")
    return out.select("reference", "center_us", "mean", "std", "ptp", "median")


_N, _FS, _FMAX = 64, 100.0, 10.0


def _psd_sql(power: str) -> str:
    """The spectrum by its definition: detrend by least squares, taper, discrete Fourier transform."""
    return f"""WITH x AS (SELECT vec_id, unnest(range(0, {_N})) AS i, unnest(embedding) AS v FROM embeddings WHERE len(embedding) = {_N}),
  t AS (SELECT vec_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM x GROUP BY 1),
  d AS (SELECT x.vec_id, i, (v - a - b * i) * (0.5 - 0.5 * cos(2 * pi() * i / {_N})) AS y FROM x JOIN t USING (vec_id)),
  k AS (SELECT unnest(range(0, 7)) AS k), w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / {_N}), 2)) AS w FROM (SELECT unnest(range(0, {_N})) AS i)),
  f AS (SELECT vec_id, k, (CASE WHEN k = 0 THEN 1 ELSE 2 END) / ({_FS} * max(w)) * (pow(sum(y * cos(2 * pi() * k * i / {_N})), 2) + pow(sum(y * sin(2 * pi() * k * i / {_N})), 2)) AS p FROM d, k, w GROUP BY 1, 2)
  SELECT vec_id, k AS bin, {power} AS power FROM f"""


def _spectra(spark, sf_dir, **how):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return spectral.power_spectrum(rows, samples="embedding", n=_N, fs=_FS, fmax=_FMAX, **how).where("power is not null")


@query("f1_power_spectrum", _psd_sql("p * 1000"), "power")
def f1(spark, sf_dir):
    s = _spectra(spark, sf_dir, scale="density").select("vec_id", F.posexplode("power").alias("bin", "power"))
    return s.select("vec_id", F.col("bin").cast("long").alias("bin"), (F.col("power") * 1000).alias("power"))


@query("f1_power_spectrum_db", _psd_sql("10 * log10(p + 1e-6)"), "power")
def f1b(spark, sf_dir):
    """Decibels above a floor of 1e-6: bin 0 of a detrended signal is rounding noise, far below it in any engine."""
    s = _spectra(spark, sf_dir, scale="density").select("vec_id", F.posexplode("power").alias("bin", "power"))
    return s.select("vec_id", F.col("bin").cast("long").alias("bin"), (10 * F.log10(F.col("power") + 1e-6)).alias("power"))


@query("f2_frequencies", f"WITH n AS (SELECT vec_id, len(embedding) AS n FROM embeddings WHERE len(embedding) = {_N}), k AS (SELECT unnest(range(0, {_N} // 2 + 1)) AS k) SELECT vec_id, k AS bin, k * {_FS} / n AS hz FROM n, k WHERE k * {_FS} / n <= {_FMAX}", "hz")
def f2(spark, sf_dir):
    freqs = spectral.frequencies(_N, _FS, _FMAX)
    wide = spectral.bins_to_columns(_spectra(spark, sf_dir), len(freqs), freqs=freqs)
    return wide.select("vec_id", F.posexplode(F.array(*(f"f_{i:03d}_hz" for i in range(len(freqs))))).alias("bin", "hz")).withColumn("bin", F.col("bin").cast("long"))


@query("f10_magnitude_spectrogram", """WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  w AS (SELECT vec_id, window_, i - 8 * window_ AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - 8 * window_) / 15)) AS y FROM x, (SELECT unnest(range(0, 7)) AS window_) WHERE i >= 8 * window_ AND i < 8 * window_ + 16),
  k AS (SELECT unnest(range(0, 9)) AS k), t AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 15), 2)) AS t FROM (SELECT unnest(range(0, 16)) AS i))
  SELECT vec_id, window_ AS "window", (8 * window_ + 8) / 50.0 AS time_s, k AS bin, 1000 * (CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / (50.0 * max(t)) * (pow(sum(y * cos(2 * pi() * k * j / 16)), 2) + pow(sum(y * sin(2 * pi() * k * j / 16)), 2)) AS power FROM w, k, t GROUP BY 1, 2, 3, 4""", "time_s power")
def f10(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    s = spectral.magnitude_spectrogram(e, keys=["vec_id"], value="v", index="i", fs=50.0, n=16, overlap=8, scale="density")
    return s.select("vec_id", "window", "time_s", F.posexplode("power").alias("bin", "power")).select("vec_id", "window", "time_s", F.col("bin").cast("long").alias("bin"), (F.col("power") * 1000).alias("power"))


@query("r2_bins_to_columns", f"WITH s AS ({_psd_sql('p * 1000')}) SELECT vec_id, max(power) FILTER (bin = 1) AS p_001, max(power) FILTER (bin = 6) AS p_006 FROM s GROUP BY 1", "p_001 p_006")
def r2(spark, sf_dir):
    wide = spectral.bins_to_columns(_spectra(spark, sf_dir, scale="density"), 7)
    return wide.select("vec_id", (F.col("p_001") * 1000).alias("p_001"), (F.col("p_006") * 1000).alias("p_006"))


@query("f3_spectrogram", f"""WITH {EV}, {_WIN}, c AS (SELECT reference, center_us FROM wi GROUP BY 1, 2 HAVING count(v) = 7), y AS (SELECT reference, center_us, place_us // 43200000000 AS i, v FROM wi JOIN c USING (reference, center_us)),
  m AS (SELECT reference, center_us, avg(v) AS a FROM y GROUP BY 1, 2), z AS (SELECT reference, center_us, i, (v - a) * (0.5 - 0.5 * cos(2 * pi() * i / 7)) AS y FROM y JOIN m USING (reference, center_us)),
  w AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 7), 2)) AS w FROM (SELECT unnest(range(0, 7)) AS i))
  SELECT reference, center_us, 'v' AS signal, 2 / (2.0 * max(w)) * (pow(sum(y * cos(2 * pi() * i / 7)), 2) + pow(sum(y * sin(2 * pi() * i / 7)), 2)) AS p_001 FROM z, w GROUP BY 1, 2""", "p_001")
def f3(spark, sf_dir):
    """Grid, bounded interpolation, windows, complete ones only, spectrum: two samples a day stand for the rate."""
    arrays = spectral.window_arrays(_windows(spark, sf_dir), ["v"], keys=["reference"])
    s = spectral.power_spectrum(arrays, samples="samples", n=7, fs=2.0, fmax=1.0, detrend="constant", scale="density").where("power is not null")
    return spectral.bins_to_columns(s, 2).select("reference", "center_us", "signal", "p_001")


@query("r11_complete_signals", f"WITH {EV}, f AS (SELECT reference, event_type AS signal, avg(value) AS p FROM ev WHERE event_type = 'view' OR reference % 2 = 0 GROUP BY 1, 2), r AS (SELECT DISTINCT reference FROM f), s AS (SELECT unnest(['view', 'click', 'error']) AS signal) SELECT reference, signal, coalesce(p, 0.0) AS p FROM r CROSS JOIN s LEFT JOIN f USING (reference, signal)", "p")
def r11(spark, sf_dir):
    s = events(spark, sf_dir).where("event_type = 'view' or reference % 2 = 0").groupBy("reference", F.col("event_type").alias("signal")).agg(F.array(F.avg("value")).alias("power"))
    return spectral.complete_signals(s, ["view", "click", "error"], keys=["reference"], n_bins=1).select("reference", "signal", F.col("power")[0].alias("p"))


@query("w18_spread_in_second", "SELECT event_id, epoch_us(date_trunc('hour', ts)) + (row_number() OVER w - 1) * 1000000 // count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts)) AS spread_us FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id)")
def w18(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("_time", F.date_trunc("hour", "_time"))
    return grid.spread_in_second(e, keys=["reference"], time="_time", order="event_id").select("event_id", "spread_us")


_A13 = """WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  y AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM x), z AS (SELECT *, abs(v - lag(v) OVER w) AS d, CASE WHEN sign(c) <> sign(lag(c) OVER w) THEN 1 WHEN lag(c) OVER w IS NOT NULL THEN 0 END AS s FROM y WINDOW w AS (PARTITION BY vec_id ORDER BY i))
  SELECT vec_id, count(*) AS n_samples, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, max(v) - min(v) AS ptp, sqrt(avg(v * v)) AS rms, sum(v * v) AS energy, avg(abs(v)) AS abs_mean, avg(s) AS zcr, regr_slope(v, i) AS slope, avg(d) AS diff_mean, stddev_pop(d) AS diff_std, max(d) AS diff_max FROM z GROUP BY 1"""


@query("a13_time_features", _A13, " ".join(features.STATS))
def a13(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return features.array_features(e, keys=["vec_id"], samples="x")


@query("a14_pair_features", "WITH x AS (SELECT vec_id, unnest(embedding[1:32]) AS l, unnest(embedding[33:64]) AS r FROM embeddings), y AS (SELECT vec_id, CAST(l AS DOUBLE) AS l, CAST(r AS DOUBLE) AS r FROM x) SELECT vec_id, corr(l, r) AS corr, avg(abs(l - r)) AS diff_abs_mean, sqrt(avg((l - r) * (l - r))) AS diff_rms, stddev_pop(l - r) AS diff_std FROM y GROUP BY 1", "corr diff_abs_mean diff_rms diff_std")
def a14(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(F.arrays_zip(F.slice("embedding", 1, 32).alias("l"), F.slice("embedding", 33, 32).alias("r"))))
    return features.pair_features(e.select("vec_id", F.col("l").cast("double"), F.col("r").cast("double")), keys=["vec_id"], left="l", right="r")


_ENERGY = "en AS (SELECT reference, event_type AS foot, date_trunc('day', _time) AS window_start, coalesce(stddev_samp(value), 0) AS energy, count(*) AS samples FROM ev GROUP BY 1, 2, 3)"


def _energy(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("foot", F.col("event_type"))
    return autolabel.motion_energy(e, by=["reference", "foot"], value="value", window_us=DAY)


@query("a15_motion_energy", f"WITH {EV}, {_ENERGY} SELECT * FROM en", "energy")
def a15(spark, sf_dir):
    return _energy(spark, sf_dir)


_SCORE = f"""{_ENERGY}, md AS (SELECT reference, quantile_cont(energy, 0.5) AS med, avg(energy) AS av, stddev_pop(energy) AS sd FROM en GROUP BY 1), ma AS (SELECT reference, quantile_cont(abs(energy - med), 0.5) AS mad FROM en JOIN md USING (reference) GROUP BY 1),
  sc AS (SELECT en.*, greatest(0, CASE WHEN mad > 0 THEN (energy - med) / (1.4826 * mad) WHEN sd > 0 THEN (energy - av) / sd ELSE 0 END) AS score FROM en JOIN md USING (reference) JOIN ma USING (reference))"""


@query("w11_robust_score", f"WITH {EV}, {_SCORE} SELECT * FROM sc", "energy score")
def w11(spark, sf_dir):
    return autolabel.robust_score(_energy(spark, sf_dir), by=["reference"], value="energy")


_MS = f"{_SCORE}, ms AS (SELECT reference, window_start, avg(score) AS score, CAST(sum(samples) AS BIGINT) AS samples, count(DISTINCT foot) AS feet FROM sc GROUP BY 1, 2)"


def _motion(spark, sf_dir):
    return autolabel.motion_score(autolabel.robust_score(_energy(spark, sf_dir), by=["reference"], value="energy"), by=["reference"])


@query("a16_motion_score", f"WITH {EV}, {_MS} SELECT * FROM ms", "score")
def a16(spark, sf_dir):
    return _motion(spark, sf_dir)


_TH = f"{_MS}, th AS (SELECT reference, quantile_cont(score, 0.35) AS low, CASE WHEN quantile_cont(score, 0.75) <= quantile_cont(score, 0.35) THEN max(score) ELSE quantile_cont(score, 0.75) END AS high FROM ms GROUP BY 1)"


@query("a17_thresholds", f"WITH {EV}, {_TH} SELECT * FROM th", "low high")
def a17(spark, sf_dir):
    return autolabel.thresholds(_motion(spark, sf_dir), by=["reference"])


@query("a35_window_class", f"WITH {EV}, {_TH} SELECT reference, window_start, CASE WHEN round(score, 8) >= round(high, 8) THEN 'walking' WHEN round(score, 8) <= round(low, 8) THEN 'not_walking' ELSE 'ambiguous' END AS label FROM ms JOIN th USING (reference)")
def a35(spark, sf_dir):
    m = _motion(spark, sf_dir)
    return m.join(autolabel.thresholds(m, by=["reference"]), "reference").select("reference", "window_start", autolabel.window_class(F.col("score"), F.col("low"), F.col("high"), True).alias("label"))


_SEG = f"""{_TH}, cw AS (SELECT ms.*, CASE WHEN score >= high THEN 'walking' WHEN score <= low THEN 'not_walking' END AS label FROM ms JOIN th USING (reference)), cz AS (SELECT * FROM cw WHERE label IS NOT NULL),
  cn AS (SELECT *, CASE WHEN lag(label) OVER w = label AND epoch_us(window_start) - epoch_us(lag(window_start) OVER w) <= 129600000000 THEN 0 ELSE 1 END AS new FROM cz WINDOW w AS (PARTITION BY reference ORDER BY window_start)),
  cs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY reference ORDER BY window_start) AS BIGINT) AS segment FROM cn),
  sg AS (SELECT reference, segment, min(label) AS label, min(window_start) AS start, max(window_start) + INTERVAL 1 DAY AS stop, avg(score) AS mean_score, CAST(sum(samples) AS BIGINT) AS samples, min(feet) AS feet_min, count(*) AS n_windows, (epoch_us(max(window_start)) + 86400000000 - epoch_us(min(window_start))) / 1000000.0 AS duration_s FROM cs GROUP BY 1, 2)"""


#: Scores and thresholds that differ by the rounding of sums alone count as equal, as in autolabel.window_class.
_SEG_ROUNDED = _SEG.replace("CASE WHEN score >= high THEN 'walking' WHEN score <= low THEN", "CASE WHEN round(score, 8) >= round(high, 8) THEN 'walking' WHEN round(score, 8) <= round(low, 8) THEN")


@query("a18_suggested_segments", f"WITH {EV}, {_SEG_ROUNDED} SELECT * FROM sg WHERE duration_s >= 100000", "mean_score duration_s")
def a18(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("foot", F.col("event_type"))
    return autolabel.suggest(e, block="reference", value="value", window_us=DAY, least_s=100000)


@query("w5_label_segments", f"WITH {EV}, {_SEG_ROUNDED} SELECT reference, window_start, segment FROM cs")
def w5(spark, sf_dir):
    m = _motion(spark, sf_dir)
    c = m.join(autolabel.thresholds(m, by=["reference"]), "reference").withColumn("label", autolabel.window_class(F.col("score"), F.col("low"), F.col("high"))).where("label is not null")
    return segments.gap_segments(c, by=["reference"], time="window_start", gap_us=int(1.5 * DAY), change=["label"], bucket_us=10 * DAY).select("reference", "window_start", "segment")


@query("a36_block_summary", f"WITH {EV}, {_SEG}, g AS (SELECT reference, count(*) FILTER (label = 'walking') AS walking_segments, count(*) FILTER (label = 'not_walking') AS not_walking_segments FROM sg WHERE duration_s >= 200000 GROUP BY 1) SELECT r.reference, raw_rows, n_windows, low, high, coalesce(walking_segments, 0) AS walking_segments, coalesce(not_walking_segments, 0) AS not_walking_segments, CASE WHEN coalesce(walking_segments, 0) + coalesce(not_walking_segments, 0) = 0 THEN 'no_segments' ELSE 'ok' END AS status FROM (SELECT reference, count(*) AS raw_rows FROM ev GROUP BY 1) r JOIN (SELECT reference, count(*) AS n_windows FROM ms GROUP BY 1) m USING (reference) JOIN th USING (reference) LEFT JOIN g USING (reference)", "low high")
def a36(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("foot", F.col("event_type"))
    m = _motion(spark, sf_dir)
    runs = autolabel.suggest(e, block="reference", value="value", window_us=DAY, least_s=200000)
    return autolabel.block_summary(e, m, autolabel.thresholds(m, by=["reference"]), runs, block="reference")


_GAP = f"WITH {EV}, n AS (SELECT event_id, reference, _time, event_type, value, CASE WHEN epoch_us(_time) - epoch_us(lag(_time) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS BIGINT) AS segment FROM n)"


@query("w1_gap_segments", f"{_GAP}, g AS (SELECT *, CAST(sum(new) OVER (ORDER BY reference, _time, event_id) - 1 AS BIGINT) AS block_id FROM s) SELECT event_id, segment, block_id FROM g")
def w1(spark, sf_dir):
    s = segments.gap_segments(events(spark, sf_dir), by=["reference"], time="_time", tie=["event_id"], gap_us=12 * HOUR, bucket_us=10 * DAY)
    return segments.global_blocks(s).select("event_id", "segment", "block_id")


@query("w3_gap_islands", f"{_GAP} SELECT reference, segment, min(_time) AS run_start, max(_time) AS run_end, count(*) AS n_windows, (epoch_us(max(_time)) - epoch_us(min(_time))) / 1000000.0 + 1 AS duration_s FROM s GROUP BY 1, 2", "duration_s")
def w3(spark, sf_dir):
    s = segments.gap_segments(events(spark, sf_dir), by=["reference"], time="_time", tie=["event_id"], gap_us=12 * HOUR, bucket_us=10 * DAY)
    return segments.run_table(s, by=["reference", "segment"], time="_time", pad_s=1.0)


@query("w4_reason_islands", f"WITH {EV}, n AS (SELECT event_id, reference, _time, CASE WHEN epoch_us(_time) - epoch_us(lag(_time) OVER w) <= 43200000000 AND event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)) SELECT event_id, CAST(sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS BIGINT) AS segment FROM n")
def w4(spark, sf_dir):
    return segments.gap_segments(events(spark, sf_dir), by=["reference"], time="_time", tie=["event_id"], gap_us=12 * HOUR, bucket_us=10 * DAY, change=["event_type"]).select("event_id", "segment")


@query("a32_joined_labels", f"{_GAP} SELECT reference, segment, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS labels FROM s GROUP BY 1, 2")
def a32(spark, sf_dir):
    s = segments.gap_segments(events(spark, sf_dir), by=["reference"], time="_time", tie=["event_id"], gap_us=12 * HOUR, bucket_us=10 * DAY)
    return selection.joined_labels(s, by=["reference", "segment"], label="event_type")


_TR = f"{_GAP}, t AS (SELECT event_id, value > 20 AS label, least(CASE WHEN (lag(value) OVER w > 20) <> (value > 20) THEN epoch_us(_time) - epoch_us(lag(_time) OVER w) END, CASE WHEN (lead(value) OVER w > 20) <> (value > 20) THEN epoch_us(lead(_time) OVER w) - epoch_us(_time) END) / 1000000.0 AS nearest_transition_s FROM s WINDOW w AS (PARTITION BY reference, segment ORDER BY _time, event_id))"


def _transitions(spark, sf_dir):
    s = segments.gap_segments(events(spark, sf_dir), by=["reference"], time="_time", tie=["event_id"], gap_us=12 * HOUR, bucket_us=10 * DAY).withColumn("label", F.col("value") > 20)
    return segments.transition_distance(s, by=["reference", "segment"], time="_time", label="label", tie=["event_id"])


@query("w6_transition_distance", f"{_TR} SELECT event_id, nearest_transition_s FROM t", "nearest_transition_s")
def w6(spark, sf_dir):
    return _transitions(spark, sf_dir).select("event_id", "nearest_transition_s")


@query("w6_transition_filter", f"{_TR} SELECT event_id, coalesce(nearest_transition_s <= 7200, FALSE) AS removed FROM t")
def w6b(spark, sf_dir):
    kept, removed = segments.transition_filter(_transitions(spark, sf_dir), 7200)
    return kept.select("event_id", F.lit(False).alias("removed")).unionByName(removed.select("event_id", F.lit(True).alias("removed")))


@query("a31_kept_removed", f"{_TR} SELECT label, count(*) FILTER (NOT coalesce(nearest_transition_s <= 7200, FALSE)) AS n_kept, count(*) FILTER (nearest_transition_s <= 7200) AS n_removed, count(*) FILTER (nearest_transition_s <= 7200) / count(*) AS removed_share FROM t GROUP BY 1", "removed_share")
def a31(spark, sf_dir):
    from motionlake.operators.metrics import kept_removed

    return kept_removed(_transitions(spark, sf_dir), F.coalesce(F.col("nearest_transition_s") <= 7200, F.lit(False)), by=["label"])


_MINRUN = f"WITH {PR}, x AS (SELECT *, probability >= 0.1 AS flag FROM pr), y AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)), z AS (SELECT *, sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS run FROM y)"


@query("w7_min_run", f"{_MINRUN} SELECT event_id, CASE WHEN flag AND count(*) OVER (PARTITION BY reference, run) >= 2 THEN 1 ELSE 0 END AS kept FROM z")
def w7(spark, sf_dir):
    return segments.min_run(predictions(spark, sf_dir), F.col("probability") >= 0.1, 2, by=["reference"], order=["_time", "event_id"], bucket_us=10 * DAY).select("event_id", "kept")


#: The machine, row by row, all references and grid points side by side; then what a later row sets or clears back.
_HYST = """o AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY _time, event_id) AS i FROM pr), g AS (SELECT * FROM (VALUES {grid}) AS t(hi, lo, k, m)),
  r AS (SELECT hi, lo, k, m, reference, CAST(0 AS BIGINT) AS i, FALSE AS is_on, 0 AS run, FALSE AS entered, FALSE AS left_ FROM g, (SELECT DISTINCT reference FROM o)
    UNION ALL SELECT hi, lo, k, m, reference, i, CASE WHEN is_on THEN c < m ELSE c >= k END, CASE WHEN is_on AND c >= m OR NOT is_on AND c >= k THEN 0 ELSE c END, NOT is_on AND c >= k, is_on AND c >= m
      FROM (SELECT r.hi, r.lo, r.k, r.m, r.reference, o.i, is_on, CASE WHEN is_on AND probability < lo OR NOT is_on AND probability >= hi THEN run + 1 ELSE 0 END AS c FROM r JOIN o ON o.reference = r.reference AND o.i = r.i + 1)),
  st AS (SELECT hi, lo, k, m, reference, i, CAST((is_on OR bool_or(entered) OVER (w ROWS BETWEEN CURRENT ROW AND {k1} FOLLOWING) AND coalesce(min(CASE WHEN entered THEN i END) OVER (w ROWS BETWEEN CURRENT ROW AND {k1} FOLLOWING), i + k) < i + k)
      AND NOT coalesce(min(CASE WHEN left_ THEN i END) OVER (w ROWS BETWEEN CURRENT ROW AND {m1} FOLLOWING) < i + m, FALSE) AS INTEGER) AS state FROM r WINDOW w AS (PARTITION BY hi, lo, k, m, reference ORDER BY i)),
  hy AS (SELECT o.*, st.* EXCLUDE (reference, i) FROM st JOIN o ON o.reference = st.reference AND o.i = st.i)"""


@query("w8_hysteresis", f"WITH RECURSIVE {PR}, {_HYST.format(grid='(0.1, 0.05, 2, 2)', k1=1, m1=1)} SELECT event_id, state FROM hy")
def w8(spark, sf_dir):
    return segments.hysteresis(predictions(spark, sf_dir), "probability", hi=0.1, lo=0.05, k=2, m=2, by=["reference"], order=["_time", "event_id"], bucket_us=10 * DAY).select("event_id", "state")


@query("w9_stitched_sequence", f"WITH {PR}, o AS (SELECT reference, row_number() OVER (ORDER BY n DESC, reference) AS order_index FROM (SELECT reference, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) >= 12)) SELECT event_id, row_number() OVER (ORDER BY order_index, _time, event_id) AS position FROM pr JOIN o USING (reference)")
def w9(spark, sf_dir):
    from motionlake.plans.interval_queries import _segments

    return segments.stitched(predictions(spark, sf_dir), _segments(spark, sf_dir), on=["reference"], order="order_index", time="_time", tie=["event_id"]).select("event_id", "position")


@query("w10_context_sequences", f"WITH {EV}, q AS (SELECT event_id, list(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l, lag(_time, 2) OVER w AS seq_start, lead(_time, 2) OVER w AS seq_stop FROM ev WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)) SELECT event_id, l[1] AS first_value, l[3] AS center_value, l[5] AS last_value, seq_start, seq_stop FROM q WHERE len(l) = 5", "first_value center_value last_value")
def w10(spark, sf_dir):
    s = segments.context_sequences(events(spark, sf_dir), by=["reference"], order="_time", features=["value"], length=5, tie=["event_id"])
    at = lambda i: F.col("sequence")[i][0]
    return s.select("event_id", at(0).alias("first_value"), at(2).alias("center_value"), at(4).alias("last_value"), "seq_start", "seq_stop")


@query("w12_inverse_frequency", f"WITH {EV}, c AS (SELECT reference, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_id, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM ev JOIN c USING (reference, event_type)", "weight")
def w12(spark, sf_dir):
    return balance.inverse_frequency(events(spark, sf_dir), ["reference", "event_type"]).select("event_id", "weight")


@query("m6_class_weights", "SELECT doc_id, (SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY quality)) AS class_weight FROM labels", "class_weight")
def m6(spark, sf_dir):
    return balance.class_weights(table(spark, sf_dir, "labels"), "quality").select("doc_id", "class_weight")


@query("w14_first_per_group", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def w14(spark, sf_dir):
    return segments.first_per_group(events(spark, sf_dir), ["reference"], [F.desc("value"), F.asc("event_id")], 3).select("event_id")


@query("w17_balance_by_duration", """WITH i AS (SELECT event_id, user_id AS reference, ts AS start, CAST(floor(value * 1000) AS BIGINT) + 1 AS us FROM events WHERE event_type = 'error'), r AS (SELECT *, row_number() OVER w AS round, coalesce(sum(us) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM i WINDOW w AS (PARTITION BY reference ORDER BY us DESC, start, event_id)),
  t AS (SELECT *, coalesce(sum(us) OVER (ORDER BY round, prior, reference ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT event_id, round, us / 1000000.0 AS duration_s FROM t WHERE before < 30000000""", "duration_s")
def w17(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'error'")
    stop = times.from_micros(times.micros("_time") + F.floor(F.col("value") * 1000) + 1)
    rows = e.select("event_id", "reference", F.col("_time").alias("start"), stop.alias("stop"))
    return balance.balance_by_duration(rows, by="reference", budget_s=30.0, tie=["event_id"]).select("event_id", "round", "duration_s")


@query("w19_best_row", "SELECT p_brand, p_type, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_type) AS k FROM (SELECT p_brand, p_type, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1, 2)) WHERE k = 1", "p_retailprice")
def w19(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("p_retailprice"))
    return selection.best_per_group(p, by=["p_brand"], metric="p_retailprice", name="p_type")


@query("r1_to_wide", "SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS \"A_F_l_quantity\", avg(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS \"N_O_l_quantity\", avg(l_tax) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS \"A_F_l_tax\", avg(l_tax) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS \"N_O_l_tax\" FROM lineitem GROUP BY 1", '"A_F_l_quantity" "N_O_l_quantity" "A_F_l_tax" "N_O_l_tax"')
def r1(spark, sf_dir):
    return reshape.to_wide(table(spark, sf_dir, "lineitem"), keys=["l_suppkey"], name=F.concat_ws("_", "l_returnflag", "l_linestatus"), names=["A_F", "N_O"], values=["l_quantity", "l_tax"])


@query("r3_to_unilateral", "SELECT l_orderkey, l_linenumber, 'Left' AS foot, l_quantity AS q, l_tax AS t FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'Right', l_extendedprice, l_discount FROM lineitem", "q t")
def r3(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "left_q", "l_tax": "left_t", "l_extendedprice": "right_q", "l_discount": "right_t", "l_partkey": "left_only"})  # noqa: E741
    return reshape.to_unilateral(l, keys=["l_orderkey", "l_linenumber"])


@query("p17_column_split", "SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem", "q")
def p17(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "left_q", "l_extendedprice": "right_q"})  # noqa: E741
    return reshape.to_unilateral(l, keys=["l_orderkey", "l_linenumber"], foot=None)


@query("r4_pivot_metrics", f"WITH {LB} SELECT reference, count(*) FILTER (label = 'walking') AS n_walking, coalesce(CAST(sum(label_id) FILTER (label = 'walking') AS DOUBLE), 0) AS sum_walking, count(*) FILTER (label = 'not_walking') AS n_not_walking, coalesce(CAST(sum(label_id) FILTER (label = 'not_walking') AS DOUBLE), 0) AS sum_not_walking FROM lb GROUP BY 1", "sum_walking sum_not_walking")
def r4(spark, sf_dir):
    return reshape.pivot_metrics(labels(spark, sf_dir).withColumn("label_id", F.col("label_id").cast("double")), keys=["reference"], label="label", labels=["walking", "not_walking"], value="label_id")


@query("u1_union_distinct", "SELECT user_id, event_type FROM events WHERE value > 50 UNION SELECT user_id, event_type FROM events WHERE value < 5")
def u1(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("reference", "user_id")
    return reshape.union_distinct(e.where("value > 50").select("user_id", "event_type"), e.where("value < 5").select("user_id", "event_type"))


@query("u2_union_tagged", "SELECT user_id, event_type, CASE WHEN bool_or(value > 50) THEN 'base' ELSE 'extension' END AS dataset_source FROM events WHERE value > 50 OR value < 5 GROUP BY 1, 2")
def u2(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("reference", "user_id")
    return reshape.union_keep_first({"base": e.where("value > 50").select("user_id", "event_type"), "extension": e.where("value < 5").select("user_id", "event_type")})


@query("u3_union_by_key", "SELECT user_id, arg_min(event_id, ((value <= 50), event_id)) AS event_id, CASE WHEN bool_or(value > 50) THEN 'base' ELSE 'extension' END AS dataset_source FROM events WHERE value > 50 OR value < 5 GROUP BY 1")
def u3(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("reference", "user_id")
    return reshape.union_keep_first({"base": e.where("value > 50").select("user_id", "event_id"), "extension": e.where("value < 5").select("user_id", "event_id")}, keys=["user_id"], tie=["event_id"])


@query("u4_duplicate_keys", "SELECT count(*) AS n_rows, count(DISTINCT (user_id, event_type, date_trunc('day', ts))) AS n_keys, count(*) - count(DISTINCT (user_id, event_type, date_trunc('day', ts))) AS n_duplicates FROM events")
def u4(spark, sf_dir):
    return reshape.duplicates(events(spark, sf_dir).withColumn("day", F.date_trunc("day", "_time")), ["reference", "event_type", "day"])


@query("u5_missing_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u5(spark, sf_dir):
    return reshape.missing_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("u5_table_diff", "SELECT count(*) FILTER (a.event_id IS NOT NULL AND b.event_id IS NOT NULL) AS n_common, count(*) FILTER (b.event_id IS NULL) AS n_left_only, count(*) FILTER (a.event_id IS NULL) AS n_right_only, max(abs(a.value - b.value)) AS max_abs_diff FROM (SELECT * FROM events WHERE value > 20) a FULL JOIN (SELECT event_id, value + event_id % 3 AS value FROM events WHERE value < 80) b ON a.event_id = b.event_id", "max_abs_diff")
def u5b(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "value")
    return reshape.table_diff(e.where("value > 20"), e.where("value < 80").withColumn("value", F.col("value") + F.col("event_id") % 3), keys=["event_id"], value="value")


@query("u6_union_reports", "SELECT 'events' AS report, count(*) AS n_rows, avg(value) AS mean, NULL AS labels FROM events UNION ALL SELECT 'labels', count(*), NULL, count(DISTINCT quality) FROM labels", "mean")
def u6(spark, sf_dir):
    a = events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("value").alias("mean"))
    b = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("quality").alias("labels"))
    return reshape.union_reports({"events": a, "labels": b})


@query("r8_halo_windows", f"WITH {EV} SELECT event_id, avg(value) OVER (PARTITION BY reference ORDER BY _time RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING) AS near_mean FROM ev", "near_mean")
def r8b(spark, sf_dir):
    """A window of six hours on both sides, computed by day buckets with a halo: no reference is one partition."""
    rows = with_halo(events(spark, sf_dir), "_time", DAY, 6 * HOUR).withColumn("_us", times.micros("_time"))
    w = Window.partitionBy("reference", "bucket").orderBy("_us").rangeBetween(-6 * HOUR, 6 * HOUR)
    return rows.withColumn("near_mean", F.avg("value").over(w)).where("not halo").select("event_id", "near_mean")


@query("a34_peak_cadence", """WITH RECURSIVE x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, round(CAST(unnest(embedding) AS DOUBLE), 1) AS v FROM embeddings),
  s AS (SELECT vec_id, avg(v) + 0.6 * stddev_samp(v) AS high, (max(i) - min(i)) / 50.0 AS seconds FROM x GROUP BY 1), c AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
  l AS (SELECT vec_id, run, min(v) AS v, (min(i) + max(i)) // 2 AS i FROM (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY i) AS run FROM c) GROUP BY 1, 2), q AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS f FROM l WINDOW w AS (PARTITION BY vec_id ORDER BY run)),
  pk AS (SELECT q.vec_id, i, row_number() OVER (PARTITION BY q.vec_id ORDER BY v DESC, i DESC) AS k FROM q JOIN s USING (vec_id) WHERE v > p AND v > f AND v >= high),
  r AS (SELECT vec_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM s
    UNION ALL SELECT r.vec_id, pk.k, CASE WHEN len(list_filter(kept, lambda y: abs(y - i) < 4)) > 0 THEN kept ELSE list_append(kept, i) END FROM r JOIN pk ON pk.vec_id = r.vec_id AND pk.k = r.k + 1),
  f AS (SELECT vec_id, max(len(kept)) AS n_peaks FROM r GROUP BY 1) SELECT vec_id, n_peaks, CASE WHEN seconds > 0 THEN 60.0 * n_peaks / seconds ELSE 0 END AS cadence FROM f JOIN s USING (vec_id)""", "cadence")
def a34(spark, sf_dir):
    """Components are rounded to one digit, so that plateaus and ties occur."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: F.round(x.cast("double"), 1))).alias("i", "v"))
    return features.peak_cadence(e, keys=["vec_id"], value="v", order="i", hz=50.0, distance=4)


@query("a34_recording_features", f"WITH {EV} SELECT reference, (epoch_us(max(_time)) - epoch_us(min(_time))) / 1e6 AS duration_s, avg(value) AS mean_value, stddev_samp(value) AS std_value, count(*) AS n_samples FROM ev GROUP BY 1", "duration_s mean_value std_value")
def a34b(spark, sf_dir):
    return features.recording_features(events(spark, sf_dir).withColumn("us", times.micros("_time")), keys=["reference"], value="value", time_us="us")


@query("f6_review_reasons", "SELECT doc_id, CASE WHEN doc_id % 2 = quality AND toxic <> quality THEN 'b_wrong' WHEN doc_id % 2 <> quality AND toxic = quality THEN 'a_wrong' WHEN doc_id % 2 = toxic AND toxic <> quality THEN 'both_wrong' WHEN abs((doc_id % 10 - doc_id % 7) / 10.0) >= 0.25 THEN 'probabilities_differ' ELSE 'none' END AS review_reason, (doc_id % 10 - doc_id % 7) / 10.0 AS probability_delta FROM labels", "probability_delta")
def f6(spark, sf_dir):
    from motionlake.operators.corrections import review_reason

    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("doc_id") % 2).alias("a_prediction"), F.col("toxic").alias("b_prediction"), ((F.col("doc_id") % 7) / 10).alias("a_probability"), ((F.col("doc_id") % 10) / 10).alias("b_probability"))
    return review_reason(rows, "a", "b", "quality", margin=0.25).select("doc_id", "review_reason", "probability_delta")


@query("f7_error_runs", f"WITH {PR}, x AS (SELECT *, target = 0 AND probability >= 0.1 AS flag FROM pr), y AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)), z AS (SELECT *, sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS run FROM y) SELECT reference, min(_time) AS run_start, count(*) AS n_windows FROM z WHERE flag GROUP BY reference, run HAVING count(*) >= 2")
def f7(spark, sf_dir):
    p = predictions(spark, sf_dir)
    flag = lab.error_mask(F.col("target"), lab.predicted(F.col("probability"), 0.1), "fp")
    rows = segments.islands(p, flag, by=["reference"], order=["_time", "event_id"], bucket_us=10 * DAY).where("flag")
    return segments.run_table(rows, by=["reference", "run"], time="_time", least=2).select("reference", "run_start", "n_windows")

"""Queries over joins of points and intervals (J) and over pieces of intervals (R5-R8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators import corrections, coverage, intervals, reshape, segments, selection
from motionlake.plans.common import EV, EX, LB, PR, events, exclusions, labels, predictions, query, table

_LABELLED = """SELECT e.event_id, e.reference, coalesce({pick}(l.label, (l.start, l.stop, l.label)), 'NO_LABEL') AS label
  FROM ev e LEFT JOIN lb l ON e.reference = l.reference AND e._time >= l.start + INTERVAL {shift} SECOND AND e._time < l.stop + INTERVAL {shift} SECOND GROUP BY e.event_id, e.reference"""


def _label(spark, sf_dir, **how):
    points = events(spark, sf_dir).select("event_id", "reference", "_time")
    return intervals.label_points(points, labels(spark, sf_dir), **how).select("event_id", "reference", "label")


@query("j1_label_first", f"WITH {LB} {_LABELLED.format(pick='arg_min', shift=0)}")
def j1(spark, sf_dir):
    return _label(spark, sf_dir)


@query("j2_label_last", f"WITH {LB} {_LABELLED.format(pick='arg_max', shift=0)}")
def j2(spark, sf_dir):
    return _label(spark, sf_dir, overlap="last")


@query("j3_label_offset", f"WITH {LB} {_LABELLED.format(pick='arg_max', shift=7200)}")
def j3(spark, sf_dir):
    return _label(spark, sf_dir, overlap="last", offset_s=7200)


@query("j4_label_fallback", f"WITH {LB}, m AS ({_LABELLED.format(pick='arg_min', shift=0)}) SELECT event_id, CASE WHEN label IN ('walking', 'not_walking') THEN label ELSE 'not_walking' END AS label FROM m")
def j4(spark, sf_dir):
    return _label(spark, sf_dir).select("event_id", lab.fallback(F.col("label"), "not_walking").alias("label"))


@query("j5_asof_nearest", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'view'),
  m AS (SELECT l.event_id, l.reference, r.event_id AS right_event_id, r.value AS right_value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(r._time) - epoch_us(l._time)), r._time > l._time, r.event_id DESC) AS k
    FROM l JOIN r ON l.reference = r.reference AND abs(epoch_us(r._time) - epoch_us(l._time)) <= 7200000000) SELECT event_id, reference, right_event_id, right_value FROM m WHERE k = 1""", "right_value")
def j5(spark, sf_dir):
    e = events(spark, sf_dir)
    found = intervals.asof_nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), on="_time", key="event_id", tolerance_us=7200 * times.SECOND, right_columns=["event_id", "value"], tie="event_id")
    return found.select("event_id", "reference", "right_event_id", "right_value")


@query("j6_exclude_windows", f"WITH {EV} SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'error' AND x.reference = ev.reference AND date_trunc('day', x._time) = date_trunc('day', ev._time))")
def j6(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.date_trunc("day", "_time"))
    return intervals.exclude_windows(e, e.where("event_type = 'error'"), keys=["reference", "day"]).select("event_id")


@query("j7_exclude_points", f"WITH {EX} SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.reference = ev.reference AND ev._time BETWEEN ex.start AND ex.stop)")
def j7(spark, sf_dir):
    return intervals.exclude_points(events(spark, sf_dir), exclusions(spark, sf_dir)).select("event_id")


def _folds(spark, sf_dir):
    """Every reference is tested by one of five folds, over the time of its signups."""
    spans = events(spark, sf_dir).where("event_type = 'signup'").groupBy("reference").agg(F.min("_time").alias("start"), F.max("_time").alias("stop"))
    return spans.withColumn("fold", (F.col("reference") % 5).cast("int"))


_FOLDS = "f AS (SELECT CAST(reference % 5 AS INTEGER) AS fold, reference, min(_time) AS start, max(_time) AS stop FROM ev WHERE event_type = 'signup' GROUP BY reference), k AS (SELECT DISTINCT fold FROM f)"


@query("j8_embargo", f"WITH {EV}, {_FOLDS} SELECT fold, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS checksum FROM ev, k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.fold = k.fold AND ev.reference = f.reference AND ev._time BETWEEN f.start - INTERVAL 60 SECOND AND f.stop + INTERVAL 60 SECOND) GROUP BY fold")
def j8(spark, sf_dir):
    rows = intervals.embargo(events(spark, sf_dir), _folds(spark, sf_dir), seconds=60)
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("checksum"))


@query("j9_sequence_embargo", f"WITH {EV}, {_FOLDS} SELECT fold, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS checksum FROM ev, k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.fold = k.fold AND ev.reference = f.reference AND ev._time - INTERVAL 1 HOUR <= f.stop + INTERVAL 600 SECOND AND ev._time + INTERVAL 1 HOUR >= f.start - INTERVAL 600 SECOND) GROUP BY fold")
def j9(spark, sf_dir):
    hour = F.expr("INTERVAL 1 HOUR")
    seqs = events(spark, sf_dir).withColumns({"seq_start": F.col("_time") - hour, "seq_stop": F.col("_time") + hour})
    return intervals.sequence_embargo(seqs, _folds(spark, sf_dir), seconds=600).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("checksum"))


@query("j10_apply_corrections", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS target, CASE WHEN (CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END) = 1 THEN 'walking' ELSE 'not_walking' END AS mov_type, doc_id % 5 = 0 AS corrected FROM labels")
def j10(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    data = rows.select("doc_id", F.col("quality").alias("target"), lab.label_of(F.col("quality")).alias("mov_type"))
    return corrections.apply(data, rows.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("proposed")), keys=["doc_id"])


_RUNS = """x AS (SELECT *, probability >= 0.1 AS flag FROM pr), y AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY reference ORDER BY _time, event_id) THEN 1 ELSE 0 END AS new FROM x),
  z AS (SELECT *, sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS run FROM y),
  ru AS (SELECT reference, run, min(_time) AS run_start, max(_time) AS run_end, count(*) AS n_windows, max(probability) AS max_probability FROM z WHERE flag GROUP BY reference, run)"""


def _runs(spark, sf_dir):
    rows = segments.islands(predictions(spark, sf_dir), F.col("probability") >= 0.1, by=["reference"], order=["_time", "event_id"], bucket_us=864_000 * times.SECOND)
    return segments.run_table(rows.where("flag"), by=["reference", "run"], time="_time", values=[F.max("probability").alias("max_probability")])


@query("j11_points_in_top_runs", f"WITH {PR}, {_RUNS}, t AS (SELECT * FROM ru ORDER BY n_windows DESC, max_probability DESC, reference, run_start LIMIT 20) SELECT event_id FROM pr WHERE EXISTS (SELECT 1 FROM t WHERE t.reference = pr.reference AND pr._time BETWEEN t.run_start AND t.run_end)")
def j11(spark, sf_dir):
    top = selection.top_runs(_runs(spark, sf_dir), 20).select("reference", F.col("run_start").alias("start"), F.col("run_end").alias("stop"))
    return intervals.points_inside(predictions(spark, sf_dir), top).select("event_id")


@query("j12_confirmed_points", f"WITH {LB} SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM lb WHERE lb.reference = ev.reference AND lb.label_id % 2 = ev.event_id % 2 AND ev._time BETWEEN lb.start AND lb.stop)")
def j12(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("parity", F.col("event_id") % 2)
    return intervals.points_inside(e, labels(spark, sf_dir).withColumn("parity", F.col("label_id") % 2), on=["reference", "parity"]).select("event_id")


@query("j13_label_changes", f"WITH {LB}, a AS ({_LABELLED.format(pick='arg_max', shift=0)}), b AS ({_LABELLED.format(pick='arg_max', shift=7200)}) SELECT coalesce(a.label, 'NO_LABEL') AS before, coalesce(b.label, 'NO_LABEL') AS after, count(*) AS n_rows FROM a FULL JOIN b USING (event_id) GROUP BY 1, 2")
def j13(spark, sf_dir):
    from motionlake.operators.metrics import label_changes

    return label_changes(_label(spark, sf_dir, overlap="last"), _label(spark, sf_dir, overlap="last", offset_s=7200), keys=["event_id"])


@query("j14_merge_signals", f"WITH {EV} SELECT reference, date_trunc('hour', _time) AS _time, min(value) FILTER (event_type = 'view') AS view, min(value) FILTER (event_type = 'click') AS click, min(value) FILTER (event_type = 'error') AS error FROM ev WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2", "view click error")
def j14(spark, sf_dir):
    from motionlake.sources.points import pivot_fields

    rows = events(spark, sf_dir).where("event_type in ('view', 'click', 'error')").select("reference", F.date_trunc("hour", "_time").alias("_time"), F.col("event_type").alias("field"), "value")
    return pivot_fields(rows, ["view", "click", "error"], keys=["reference", "_time"])


@query("j15_attach_metadata", "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j15(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return reshape.attach_metadata(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), meta, keys=["o_custkey"], columns=["c_mktsegment", "c_nationkey"])


@query("j17_split_by_reference", f"WITH {EV}, v AS (SELECT DISTINCT reference FROM ev WHERE event_type = 'error' AND value > 100) SELECT reference IN (SELECT reference FROM v) AS validation, count(*) AS n_rows FROM ev GROUP BY 1")
def j17(spark, sf_dir):
    from motionlake.operators.folds import split_by_reference

    e = events(spark, sf_dir)
    train, validation = split_by_reference(e, e.where("event_type = 'error' and value > 100"))
    return train.select(F.lit(False).alias("validation")).unionByName(validation.select(F.lit(True).alias("validation"))).groupBy("validation").agg(F.count(F.lit(1)).alias("n_rows"))


_SHIFTED = "sh AS (SELECT label_id, reference, offset_minutes, start + INTERVAL 1 MINUTE * offset_minutes AS shifted_start, stop + INTERVAL 1 MINUTE * offset_minutes AS shifted_stop FROM lb, (SELECT unnest([-120, 0, 120]) AS offset_minutes))"


@query("j18_shifted_candidates", f"WITH {LB}, {_SHIFTED} SELECT * FROM sh")
def j18(spark, sf_dir):
    return intervals.shifted(labels(spark, sf_dir), [-120, 0, 120]).select("label_id", "reference", "offset_minutes", "shifted_start", "shifted_stop")


@query("j19_segment_rows", f"WITH {PR}, s AS (SELECT reference, row_number() OVER (ORDER BY n DESC, reference) AS order_index FROM (SELECT reference, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) >= 12)) SELECT event_id, order_index FROM pr JOIN s USING (reference)")
def j19(spark, sf_dir):
    return predictions(spark, sf_dir).join(_segments(spark, sf_dir), "reference").select("event_id", "order_index")


def _segments(spark, sf_dir):
    from pyspark.sql import Window

    s = events(spark, sf_dir).where("event_type = 'signup'").groupBy("reference").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    return s.withColumn("order_index", F.row_number().over(Window.orderBy(F.desc("n"), "reference"))).select("reference", "order_index")  # a row for each reference


@query("j20_overlaps", f"WITH {LB} SELECT label_id, previous_stop FROM (SELECT *, lag(stop) OVER (PARTITION BY reference ORDER BY start, stop, label_id) AS previous_stop FROM lb) WHERE start < previous_stop")
def j20(spark, sf_dir):
    return intervals.interval_overlaps(labels(spark, sf_dir), tie=["label_id"]).select("label_id", "previous_stop")


@query("j21_resolve_conflicts", f"""WITH RECURSIVE {LB}, n AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY start, stop, label, label_id) AS i FROM lb),
  p AS (SELECT a.reference, a.i AS i, b.i AS j, CASE WHEN epoch_us(a.stop) - epoch_us(a.start) <= epoch_us(b.stop) - epoch_us(b.start) THEN a.i ELSE b.i END AS loser, row_number() OVER (PARTITION BY a.reference ORDER BY a.i, b.i) AS k FROM n a JOIN n b ON a.reference = b.reference AND a.i < b.i AND b.start < a.stop AND a.label <> b.label),
  r AS (SELECT DISTINCT reference, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM lb
    UNION ALL SELECT r.reference, p.k, CASE WHEN list_contains(gone, p.i) OR list_contains(gone, p.j) THEN gone ELSE list_append(gone, loser) END FROM r JOIN p ON p.reference = r.reference AND p.k = r.k + 1),
  f AS (SELECT reference, arg_max(gone, k) AS gone FROM r GROUP BY 1) SELECT label_id, n.reference, start, stop, label, list_contains(gone, n.i) AS dropped FROM n JOIN f USING (reference)""")
def j21(spark, sf_dir):
    return intervals.resolve_conflicts(labels(spark, sf_dir))


@query("r5_split_intervals", f"""WITH {LB}, q AS (SELECT *, unnest(range(0, CAST(ceil(86400 / 25000.0) AS BIGINT))) AS chunk FROM lb)
  SELECT label_id, chunk, start + INTERVAL 1 SECOND * (chunk * 25000) AS piece_start, least(start + INTERVAL 1 SECOND * ((chunk + 1) * 25000), stop) AS piece_stop FROM q WHERE epoch_us(least(start + INTERVAL 1 SECOND * ((chunk + 1) * 25000), stop) - (start + INTERVAL 1 SECOND * (chunk * 25000))) >= 12000000000""")
def r5(spark, sf_dir):
    return intervals.split_intervals(labels(spark, sf_dir), 25000, 12000).select("label_id", "chunk", "piece_start", "piece_stop")


@query("r6_tile_intervals", f"""WITH {LB}, q AS (SELECT *, unnest(range(0, 5)) AS tile FROM lb), w AS (SELECT label_id, tile, start + INTERVAL 1 SECOND * (tile * 20000) AS tile_start, least(start + INTERVAL 1 SECOND * ((tile + 1) * 20000), stop) AS tile_stop FROM q)
  SELECT *, strftime(tile_start + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tile_from_local, strftime(tile_stop, '%Y-%m-%dT%H:%M:%SZ') AS tile_until_utc FROM w""")
def r6(spark, sf_dir):
    return intervals.tile_intervals(labels(spark, sf_dir), 20000, zone="Asia/Tokyo").select("label_id", "tile", "tile_start", "tile_stop", "tile_from_local", "tile_until_utc")


@query("r7_spread_blocks", f"WITH {LB}, q AS (SELECT *, unnest(range(0, 4)) AS block FROM lb) SELECT label_id, block, make_timestamp(CAST(floor((epoch_us(start) + block * (86400000000 - 600000000) / 3.0) / 1000000) * 1000000 AS BIGINT)) AS block_start FROM q")
def r7(spark, sf_dir):
    return intervals.spread_blocks(labels(spark, sf_dir), 4, 600).select("label_id", "block", "block_start")


@query("r8_core_chunks", f"WITH {LB}, q AS (SELECT *, unnest(range(0, 3)) AS chunk FROM lb), c AS (SELECT label_id, reference, chunk, start + INTERVAL 1 SECOND * (chunk * 28800) AS core_start, start + INTERVAL 1 SECOND * ((chunk + 1) * 28800) AS core_stop FROM q) SELECT c.label_id, chunk, count(*) AS n_rows FROM c JOIN ev ON ev.reference = c.reference AND ev._time >= core_start AND ev._time < core_stop GROUP BY 1, 2")
def r8(spark, sf_dir):
    from motionlake.sources.points import scan_points

    chunks = intervals.core_chunks(labels(spark, sf_dir), 28800, 600).select("label_id", "reference", "chunk", "core_start", "core_stop", F.col("query_start").alias("start"), F.col("query_stop").alias("stop"))
    read = scan_points(events(spark, sf_dir).withColumnRenamed("event_type", "field"), chunks, fields=["view", "click", "error", "signup", "purchase"])
    return intervals.keep_core(read, "_time").groupBy("label_id", "chunk").agg(F.count(F.lit(1)).alias("n_rows"))


def _counts(spark, sf_dir):
    from motionlake.sources.points import scan_points

    l = labels(spark, sf_dir)  # noqa: E741
    found = scan_points(events(spark, sf_dir).withColumnRenamed("event_type", "field"), l.select("label_id", "reference", "start", "stop"), fields=["view", "click"])
    counts = coverage.count_records(found, keys=["label_id"])
    return coverage.with_missing(l.select("label_id", "reference"), counts, keys=["label_id"], columns=["left_records", "right_records", "total_records"])


_COUNTS = "co AS (SELECT l.label_id, l.reference, count(*) FILTER (foot = 'Left') AS left_records, count(*) FILTER (foot = 'Right') AS right_records, count(foot) AS total_records FROM lb l LEFT JOIN ev e ON e.reference = l.reference AND e._time >= l.start AND e._time < l.stop AND e.foot IS NOT NULL GROUP BY 1, 2)"


@query("a1_count_records", f"WITH {LB}, {_COUNTS} SELECT * FROM co")
def a1(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("a4_block_status", f"WITH {LB}, {_COUNTS} SELECT label_id, least(left_records, right_records) AS min_records_per_foot, CASE WHEN greatest(left_records, right_records) = 0 THEN 'no_records' WHEN least(left_records, right_records) = 0 THEN 'only_some' WHEN least(left_records, right_records) < 2 THEN 'low_records' ELSE 'valid' END AS status FROM co")
def a4(spark, sf_dir):
    return coverage.block_status(_counts(spark, sf_dir), 2).select("label_id", "min_records_per_foot", "status")


@query("w15_quota_scan", f"WITH {LB}, {_COUNTS}, v AS (SELECT *, row_number() OVER w AS scan_rank, coalesce(sum(CASE WHEN total_records >= 2 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS valid_before FROM co WINDOW w AS (PARTITION BY reference ORDER BY label_id)) SELECT label_id, scan_rank, valid_before FROM v WHERE scan_rank <= 8 AND valid_before < 2")
def w15(spark, sf_dir):
    return coverage.quota_scan(_counts(spark, sf_dir), by=["reference"], order=["label_id"], valid=F.col("total_records") >= 2, most_valid=2, most_scanned=8).select("label_id", "scan_rank", "valid_before")


@query("w16_first_success", f"WITH {LB}, {_COUNTS}, v AS (SELECT *, row_number() OVER w AS try_rank, coalesce(sum(CASE WHEN total_records >= 3 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM co WINDOW w AS (PARTITION BY reference ORDER BY label_id)) SELECT label_id, try_rank, total_records >= 3 AS succeeded FROM v WHERE b = 0")
def w16(spark, sf_dir):
    return coverage.up_to_first_success(_counts(spark, sf_dir), by=["reference"], order=["label_id"], ok=F.col("total_records") >= 3).select("label_id", "try_rank", "succeeded")


_INSIDE = "i AS (SELECT l.label_id, e.foot, e._time FROM lb l JOIN ev e ON e.reference = l.reference AND e._time >= l.start AND e._time < l.stop AND e.foot IS NOT NULL)"


@query("c7_diagnose", f"""WITH {LB}, {_INSIDE}, p AS (SELECT label_id, count(DISTINCT foot) AS n_feet, greatest(min(_time) FILTER (foot = 'Left'), min(_time) FILTER (foot = 'Right')) AS a, least(max(_time) FILTER (foot = 'Left'), max(_time) FILTER (foot = 'Right')) AS b FROM i GROUP BY 1)
  SELECT lb.label_id, CASE WHEN coalesce(n_feet, 0) = 0 THEN 'no_records' WHEN n_feet < 2 THEN 'only_some_feet' WHEN a >= b THEN 'no_common_interval' ELSE 'valid_both_feet' END AS status FROM lb LEFT JOIN p USING (label_id)""")
def c7(spark, sf_dir):
    from motionlake.sources.points import scan_points

    l = labels(spark, sf_dir)  # noqa: E741
    found = scan_points(events(spark, sf_dir).withColumnRenamed("event_type", "field"), l.select("label_id", "reference", "start", "stop"), fields=["view", "click"])
    return coverage.diagnose(l.select("label_id", "start", "stop"), found, key="label_id").select("label_id", "status")


@query("a28_signal_review", f"""WITH {LB}, f AS (SELECT l.label_id, e.event_type AS foot, count(*) AS n, stddev_samp(value) AS s, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM lb l JOIN ev e ON e.reference = l.reference AND e._time BETWEEN l.start - INTERVAL 3600 SECOND AND l.stop + INTERVAL 3600 SECOND GROUP BY 1, 2)
  SELECT lb.label_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_samples, count(foot) AS n_feet, avg(s) AS mean_std, avg(q) AS mean_iqr FROM lb LEFT JOIN f USING (label_id) GROUP BY 1""", "mean_std mean_iqr")
def a28(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("foot", F.col("event_type"))
    return corrections.signal_review(labels(spark, sf_dir), e, key="label_id", value="value", pad_s=3600).select("label_id", "n_samples", "n_feet", "mean_std", "mean_iqr")


@query("a29_signal_decision", f"""WITH {LB}, f AS (SELECT l.label_id, e.event_type AS foot, stddev_samp(value) AS s FROM lb l JOIN ev e ON e.reference = l.reference AND e._time BETWEEN l.start AND l.stop GROUP BY 1, 2),
  m AS (SELECT lb.label_id, label_id % 2 AS proposed, count(foot) AS n_feet, avg(s) AS m FROM lb LEFT JOIN f USING (label_id) GROUP BY 1)
  SELECT label_id, CASE WHEN m IS NULL OR n_feet = 0 THEN 'review' WHEN proposed = 1 AND m >= 40 THEN 'confirm' WHEN proposed = 1 AND m <= 10 THEN 'reject' WHEN proposed = 0 AND m <= 10 THEN 'confirm' WHEN proposed = 0 AND m >= 40 THEN 'reject' ELSE 'review' END AS decision FROM m""")
def a29(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("foot", F.col("event_type"))
    r = corrections.signal_review(labels(spark, sf_dir), e, key="label_id", value="value").withColumn("proposed", F.col("label_id") % 2)
    return corrections.decide(r, moving=40, still=10).select("label_id", "decision")


@query("w2_runs", f"WITH {PR}, {_RUNS} SELECT reference, run_start, run_end, n_windows, max_probability FROM ru", "max_probability")
def w2(spark, sf_dir):
    return _runs(spark, sf_dir).select("reference", "run_start", "run_end", "n_windows", "max_probability")


@query("t1_top_runs", f"WITH {PR}, {_RUNS} SELECT reference, run_start, n_windows FROM ru ORDER BY n_windows DESC, max_probability DESC, reference, run_start LIMIT 20")
def t1(spark, sf_dir):
    return selection.top_runs(_runs(spark, sf_dir), 20).select("reference", "run_start", "n_windows")


@query("t5_ranked_reviews", f"WITH {PR}, {_RUNS}, t AS (SELECT * FROM ru ORDER BY n_windows DESC, max_probability DESC, reference, run_start LIMIT 30) SELECT reference, run_start, 'R' || lpad(CAST(row_number() OVER (ORDER BY n_windows DESC, max_probability DESC, reference, run_start) AS VARCHAR), 4, '0') AS review_id FROM t")
def t5(spark, sf_dir):
    from motionlake.operators.metrics import ranked_reviews

    return ranked_reviews(_runs(spark, sf_dir), [F.desc("n_windows"), F.desc("max_probability"), F.asc("reference"), F.asc("run_start")], 30).select("reference", "run_start", "review_id")

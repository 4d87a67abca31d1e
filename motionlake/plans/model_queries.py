"""Queries over metrics, sweeps, folds, corrections, models, streams and composite jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators import corrections, extraction, ferns, folds, intervals, metrics, models, segments
from motionlake.plans import pipelines
from motionlake.plans.common import EV, LB, PR, events, labels, predictions, query, session, table
from motionlake.plans.window_queries import _HYST
from motionlake.sources import sinks
from motionlake.streaming import live, replay

_M = "round(CASE WHEN {tp}+{fp}=0 THEN 0 ELSE {tp}/({tp}+{fp}) END, 6) AS precision, round(CASE WHEN {tp}+{fn}=0 THEN 0 ELSE {tp}/({tp}+{fn}) END, 6) AS recall, round(CASE WHEN 2*{tp}+{fp}+{fn}=0 THEN 0 ELSE 2*{tp}/(2*{tp}+{fp}+{fn}) END, 6) AS f1"
_COUNTS = "count(*) FILTER ({y} = 1 AND {h}) AS tp, count(*) FILTER ({y} = 0 AND {h}) AS fp, count(*) FILTER ({y} = 1 AND NOT ({h})) AS fn, count(*) FILTER ({y} = 0 AND NOT ({h})) AS tn"
_MET = _M.format(tp="tp", fp="fp", fn="fn")
_SHORT = ["tp", "fp", "fn", "tn", "precision", "recall", "f1"]


def _judged(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.withColumns({"yhat": (F.col("doc_id") % 3 == 0).cast("int"), "fold": (F.col("doc_id") % 4).cast("int")})


_JD = "jd AS (SELECT l.*, lang, source, CAST(l.doc_id % 3 = 0 AS INTEGER) AS yhat, CAST(l.doc_id % 4 AS INTEGER) AS fold FROM labels l JOIN documents d USING (doc_id))"


@query("a21_binary_metrics", f"WITH {_JD}, c AS (SELECT lang, count(*) AS n_rows, {_COUNTS.format(y='quality', h='yhat = 1')} FROM jd GROUP BY 1) SELECT lang, n_rows, tp, fp, fn, tn, {_MET}, (tp + tn) / n_rows AS accuracy, CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END AS false_positive_rate FROM c", "accuracy false_positive_rate")
def a21(spark, sf_dir):
    return metrics.binary_metrics(_judged(spark, sf_dir), "quality", "yhat", by=["lang"]).select("lang", "n_rows", *_SHORT, "accuracy", "false_positive_rate")


@query("a22_metrics_by_source", f"WITH {_JD}, c AS (SELECT fold, source, {_COUNTS.format(y='quality', h='yhat = 1')} FROM jd GROUP BY 1, 2) SELECT fold, source, tp, fp, fn, tn, {_MET} FROM c")
def a22(spark, sf_dir):
    return metrics.binary_metrics(_judged(spark, sf_dir), "quality", "yhat", by=["fold", "source"]).select("fold", "source", *_SHORT)


@query("a23_fold_summary", f"WITH {_JD}, c AS (SELECT lang, fold, count(*) AS n_rows, {_COUNTS.format(y='quality', h='yhat = 1')} FROM jd GROUP BY 1, 2), m AS (SELECT *, CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END AS f1 FROM c) SELECT lang, count(*) AS n_folds, avg(f1) AS f1_mean, stddev_samp(f1) AS f1_sd, sum(f1 * n_rows) / sum(n_rows) AS f1_weighted FROM m GROUP BY 1", "f1_mean f1_sd f1_weighted")
def a23(spark, sf_dir):
    return metrics.fold_means(metrics.binary_metrics(_judged(spark, sf_dir), "quality", "yhat", by=["lang", "fold"]), ["f1"], by=["lang"], weight="n_rows")


@query("a24_error_summary", f"WITH {_JD}, c AS (SELECT source, count(*) AS n_rows, {_COUNTS.format(y='quality', h='yhat = 1')} FROM jd GROUP BY 1) SELECT *, CASE WHEN fp+tn=0 THEN 0 ELSE fp/(fp+tn) END AS fp_rate, CASE WHEN fn+tp=0 THEN 0 ELSE fn/(fn+tp) END AS fn_rate FROM c", "fp_rate fn_rate")
def a24(spark, sf_dir):
    return metrics.error_summary(_judged(spark, sf_dir), "quality", "yhat", by="source")


@query("a25_distribution", f"WITH {EV} SELECT event_type, count(*) AS n_rows, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max, count(*) FILTER (value < 1) AS below_1_0, count(*) FILTER (value < 10) AS below_10_0 FROM ev GROUP BY 1", "mean std min p01 p05 p50 p95 max")
def a25(spark, sf_dir):
    return metrics.distribution(events(spark, sf_dir), "value", by=["event_type"], limits=(1.0, 10.0))


@query("a26_dataset_summary", "SELECT lang, quality, count(*) AS n_rows, count(DISTINCT source) AS n_distinct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def a26(spark, sf_dir):
    return metrics.dataset_summary(_judged(spark, sf_dir), ["lang", "quality"], "source")


@query("a26_null_counts", "SELECT 'l_quantity' AS column, count(*) FILTER (l_quantity IS NULL) AS n_nulls, count(DISTINCT l_quantity) AS n_distinct FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL), count(DISTINCT l_tax) FROM lineitem")
def a26b(spark, sf_dir):
    return metrics.null_counts(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])


@query("a27_window_sizes", f"WITH {EV}, w AS (SELECT unnest([3600, 7200]) AS window_s) SELECT window_s, count(DISTINCT epoch_us(_time) // (CAST(window_s AS BIGINT) * 1000000)) AS distinct_centers, count(*) FILTER (foot = 'Left') AS left_rows, count(*) FILTER (foot = 'Right') AS right_rows FROM ev, w GROUP BY 1")
def a27(spark, sf_dir):
    return metrics.window_sizes(events(spark, sf_dir), [3600, 7200])


@query("a30_label_crosstab", "SELECT CASE quality WHEN 1 THEN 'walking' ELSE 'not_walking' END AS before, CASE toxic WHEN 1 THEN 'walking' ELSE 'not_walking' END AS after, count(*) AS n_rows FROM labels GROUP BY 1, 2")
def a30(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return metrics.label_changes(l.select("doc_id", lab.label_of(F.col("quality")).alias("label")), l.select("doc_id", lab.label_of(F.col("toxic")).alias("label")), keys=["doc_id"])


@query("a33_group_profile", f"WITH {PR} SELECT reference, count(*) AS n_rows, count(*) FILTER (target = 0) AS target_0, count(*) FILTER (target = 1) AS target_1, min(_time) AS first_time, max(_time) AS last_time FROM pr GROUP BY 1")
def a33(spark, sf_dir):
    return folds.group_profile(predictions(spark, sf_dir), group="reference", target="target", time="_time")


_VOTES = "vo AS (SELECT doc_id, quality AS target, m AS model, CAST((doc_id + m) % 3 > 0 AS INTEGER) AS prediction, ((doc_id + m) % 10) / 10.0 AS probability FROM labels, (SELECT unnest([1, 2, 3]) AS m)), cs AS (SELECT doc_id, min(target) AS target, count(DISTINCT model) AS n_models, CAST(sum(prediction) AS BIGINT) AS votes, min(probability) AS min_probability, avg(probability) AS mean_probability, max(probability) AS max_probability FROM vo GROUP BY 1)"


def _votes(spark, sf_dir):
    v = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model"))
    k = F.col("doc_id") + F.col("model")
    return corrections.consensus(v.select("doc_id", "target", "model", (k % 3 > 0).cast("int").alias("prediction"), ((k % 10) / 10).alias("probability")), keys=["doc_id"])


@query("a19_consensus", f"WITH {_VOTES} SELECT * FROM cs", "min_probability mean_probability max_probability")
def a19(spark, sf_dir):
    return _votes(spark, sf_dir)


_POLL = "po AS (SELECT event_id, reference, _time, CAST(event_id % 2 AS INTEGER) AS target, m AS model, least(probability * (6 + m) / 2.0, 1.0) AS probability, CAST(least(probability * (6 + m) / 2.0, 1.0) >= 0.4 AS INTEGER) AS prediction FROM pr, (SELECT unnest([1, 2, 3]) AS m)), pc AS (SELECT event_id, min(target) AS target, count(DISTINCT model) AS n_models, sum(prediction) AS votes, min(probability) AS min_probability, max(probability) AS max_probability FROM po GROUP BY 1), pp AS (SELECT event_id, CASE WHEN target = 0 THEN 1 ELSE 0 END AS proposed, max_probability FROM pc WHERE (target = 0 AND votes = n_models AND min_probability >= 0.5) OR (target = 1 AND votes = 0 AND max_probability <= 0.2))"


def _poll(spark, sf_dir):
    """Three models that mostly agree: the same probability, scaled by each."""
    p = predictions(spark, sf_dir).withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    p = p.withColumn("probability", F.least(F.col("probability") * (6 + F.col("model")) / 2, F.lit(1.0)))
    return p.withColumn("prediction", (F.col("probability") >= 0.4).cast("int"))


@query("a20_correction_rule", f"WITH {PR}, {_POLL} SELECT event_id, proposed FROM pp")
def a20(spark, sf_dir):
    return corrections.propose(corrections.consensus(_poll(spark, sf_dir), keys=["event_id"]), high=0.5, low=0.2).select("event_id", "proposed")


_GRID = [0.05, 0.1, 0.2, 0.4]
_SWEEP = f"sw AS (SELECT threshold, {_COUNTS.format(y='target', h='probability >= threshold')} FROM pr, (SELECT CAST(unnest([0.05, 0.1, 0.2, 0.4]) AS DOUBLE) AS threshold) GROUP BY 1)"


@query("m13_threshold_sweep", f"WITH {PR}, {_SWEEP} SELECT threshold, tp, fp, fn, tn, {_MET} FROM sw", "threshold")
def m13(spark, sf_dir):
    return metrics.sweep_threshold(predictions(spark, sf_dir), "target", "probability", _GRID).select("threshold", *_SHORT)


@query("t2_operating_point", f"WITH {PR}, {_SWEEP}, m AS (SELECT threshold, tp, fp, {_MET}, fp / (fp + tn) AS fpr FROM sw) SELECT threshold, tp, fp, recall FROM m WHERE recall >= 0.3 ORDER BY fpr, f1 DESC, threshold LIMIT 1", "threshold")
def t2(spark, sf_dir):
    s = metrics.sweep_threshold(predictions(spark, sf_dir), "target", "probability", _GRID)
    return metrics.best_operating_point(s, least_recall=0.3, order=[F.asc("false_positive_rate"), F.desc("f1"), F.asc("threshold")]).select("threshold", "tp", "fp", "recall")


_RUNSWEEP = """g AS (SELECT CAST(unnest([0.05, 0.1]) AS DOUBLE) AS threshold), k AS (SELECT unnest([1, 2]) AS min_run), x AS (SELECT *, {flag} AS flag FROM pr, g, k),
  y AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY threshold, min_run, reference ORDER BY _time, event_id)),
  z AS (SELECT *, sum(new) OVER (PARTITION BY threshold, min_run, reference ORDER BY _time, event_id) AS run FROM y),
  h AS (SELECT *, flag AND count(*) OVER (PARTITION BY threshold, min_run, reference, run) >= min_run AS hat FROM z), sw AS (SELECT threshold, min_run, {counts} FROM h GROUP BY 1, 2)"""


@query("m14_min_run_sweep", f"WITH {PR}, {_RUNSWEEP.format(flag='probability >= threshold', counts=_COUNTS.format(y='target', h='hat'))} SELECT threshold, min_run, tp, fp, fn, tn, {_MET} FROM sw", "threshold")
def m14(spark, sf_dir):
    s = metrics.sweep_min_run(predictions(spark, sf_dir), "target", "probability", [(t, k) for t in (0.05, 0.1) for k in (1, 2)], by=["reference"], order=["_time", "event_id"])
    return s.select("threshold", "min_run", *_SHORT)


@query("m15_hysteresis_sweep", f"WITH RECURSIVE {PR}, {_HYST.format(grid='(0.1, 0.05, 2, 2), (0.2, 0.1, 1, 2), (0.1, 0.1, 3, 1)', k1=2, m1=1)}, sw AS (SELECT hi AS enter, lo AS exit, k AS enter_run, m AS exit_run, {_COUNTS.format(y='target', h='state = 1')} FROM hy GROUP BY ALL) SELECT CAST(enter AS DOUBLE) AS enter, CAST(exit AS DOUBLE) AS exit, enter_run, exit_run, tp, fp, fn, tn, {_MET} FROM sw", "enter exit")
def m15(spark, sf_dir):
    grid = [(0.1, 0.05, 2, 2), (0.2, 0.1, 1, 2), (0.1, 0.1, 3, 1), (0.05, 0.1, 1, 1)]  # the last one leaves above where it enters
    s = metrics.sweep_hysteresis(predictions(spark, sf_dir), "target", "probability", grid, by=["reference"], order=["_time", "event_id"])
    return s.select("enter", "exit", "enter_run", "exit_run", *_SHORT)


_TWO = "(SELECT *, ((event_id * 7) % 100) / 100.0 AS other FROM pr)"


@query("m16_consensus_sweep", f"WITH {PR}, {_RUNSWEEP.format(flag='probability >= threshold AND other >= 0.3', counts=_COUNTS.format(y='target', h='hat')).replace('FROM pr, g', f'FROM {_TWO} pr, g')} SELECT threshold AS first_threshold, min_run, tp, fp, fn, tn, {_MET} FROM sw", "first_threshold")
def m16(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("other", ((F.col("event_id") * 7) % 100) / 100)
    s = metrics.sweep_consensus(rows, "target", "probability", "other", [(t, 0.3, k) for t in (0.05, 0.1) for k in (1, 2)], by=["reference"], order=["_time", "event_id"])
    return s.select("first_threshold", "min_run", *_SHORT)


@query("f8_consensus_gate", f"WITH {PR}, x AS (SELECT *, probability >= 0.05 AND other >= 0.3 AS flag FROM {_TWO} pr), y AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)), z AS (SELECT *, sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS run FROM y) SELECT event_id, CASE WHEN flag AND count(*) OVER (PARTITION BY reference, run) >= 3 THEN 1 ELSE 0 END AS kept FROM z")
def f8(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("other", ((F.col("event_id") * 7) % 100) / 100)
    return segments.min_run(rows, (F.col("probability") >= 0.05) & (F.col("other") >= 0.3), 3, by=["reference"], order=["_time", "event_id"], bucket_us=864_000 * times.SECOND).select("event_id", "kept")


#: crc32 of an id and a seed as text, bit by bit, in SQL.
_CRC = """b AS (SELECT doc_id, quality, list_transform(string_split(CAST(doc_id AS VARCHAR) || ':1', ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM labels),
  c AS (SELECT doc_id, quality, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda h, x: list_reduce(list_prepend(xor(h, x), [CAST(0 AS BIGINT)] || [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, CAST(3988292384 AS BIGINT)) ELSE y // 2 END)), CAST(4294967295 AS BIGINT)) AS h FROM b)"""


@query("m1_stratified_folds", f"WITH {_CRC} SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY h % 256, h, doc_id) - 1) % 5 AS INTEGER) AS fold FROM c")
def m1(spark, sf_dir):
    return folds.stratified_folds(table(spark, sf_dir, "labels"), target="quality", key="doc_id", k=5, seed=1).select("doc_id", "quality", "fold")


@query("m2_leave_one_group_out", "WITH g AS (SELECT DISTINCT lang AS fold_group FROM documents) SELECT fold_group, lang IS NOT DISTINCT FROM fold_group AS is_test, count(*) AS n_rows FROM documents, g GROUP BY 1, 2")
def m2(spark, sf_dir):
    return folds.leave_one_group_out(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").groupBy("fold_group", "is_test").agg(F.count(F.lit(1)).alias("n_rows"))


def _plan(spark, sf_dir):
    return folds.group_folds(_judged(spark, sf_dir), group="source", target="quality", source="lang", k=3, restarts=100)


@query("m3_group_folds")
def m3(spark, sf_dir):
    return _plan(spark, sf_dir)


_SOURCES = """cc AS (SELECT source, quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
  ce AS (SELECT source, lang || '' AS cell, 1.0 AS w, n FROM cc UNION ALL SELECT source, '', 1.0, n FROM cc UNION ALL SELECT source, '0' || quality, 2.0, n FROM cc UNION ALL SELECT source, lang || quality, 2.0, n FROM cc)"""


@query("m3_plan_score", f"WITH {_SOURCES}, fo AS (SELECT source, CAST((dense_rank() OVER (ORDER BY source) - 1) % 3 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM ce)), s AS (SELECT cell, w, fold, sum(n) AS n FROM ce JOIN fo USING (source) GROUP BY ALL), t AS (SELECT cell, w, sum(n) / 3.0 AS goal FROM s GROUP BY ALL) SELECT sum(w * pow((coalesce(n, 0) - goal) / goal, 2)) AS plan_score FROM t CROSS JOIN (SELECT unnest(range(3)) AS fold) f LEFT JOIN s USING (cell, w, fold)", "plan_score")
def m3b(spark, sf_dir):
    """The objective of a given plan: sources dealt in turn."""
    d = _judged(spark, sf_dir)
    turn = d.select("source").distinct().withColumn("fold", ((F.dense_rank().over(Window.orderBy("source")) - 1) % 3).cast("int"))  # a row for each source
    return folds.plan_score(d, turn, group="source", target="quality", source="lang", k=3)


@query("m4_fold_summary")
def m4(spark, sf_dir):
    return folds.fold_summary(_judged(spark, sf_dir).drop("fold"), _plan(spark, sf_dir), group="source", target="quality")


@query("m4_uncovered_groups", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source < 'src5')")
def m4b(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return folds.uncovered_groups(d, d.where("source < 'src5'"), "source")


@query("m5_rotating_validation", "WITH f AS (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) % 4 + 1 AS fold FROM documents), o AS (SELECT a.fold, b.source FROM (SELECT DISTINCT fold FROM f) a, f b WHERE b.fold <> a.fold), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY source) - 1 AS r, count(*) OVER (PARTITION BY fold) AS n FROM o) SELECT fold, source AS validation_group FROM r WHERE (fold - 1) % n = r")
def m5(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("source", (F.substring("source", 4, 9).cast("int") % 4 + 1).alias("fold")).distinct()
    return folds.rotating_validation(f, group="source")


#: Components of a vector in the embeddings table; all of them are features.
_PARTS = 64


def _ml(spark, sf_dir):
    """A binary table: vectors of two groups of labels."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", (F.col("label") < 5).cast("int").alias("target"), (F.col("vec_id") % 3).cast("int").alias("fold"), *(F.col("embedding")[i].cast("double").alias(f"p_{i:03d}") for i in range(_PARTS)))
    return rows, [f"p_{i:03d}" for i in range(_PARTS)]


def _scored(pred):
    return metrics.binary_metrics(pred, "target", "prediction", by=["fold"])


@query("m7_random_forest")
def m7(spark, sf_dir):
    rows, names = _ml(spark, sf_dir)
    return _scored(models.out_of_fold(rows, models.random_forest(names, "target"), [0, 1, 2]))


@query("m8_boosted_trees")
def m8(spark, sf_dir):
    rows, names = _ml(spark, sf_dir)
    return _scored(models.out_of_fold(rows, models.boosted_trees(names, "target", rounds=10), [0, 1, 2]))


@query("m9_logistic_regression")
def m9(spark, sf_dir):
    rows, names = _ml(spark, sf_dir)
    return _scored(models.out_of_fold(rows, models.logistic(names, "target"), [0, 1, 2]))


@query("m10_sequence_classifier")
def m10(spark, sf_dir):
    e = predictions(spark, sf_dir).withColumn("fold", (F.col("reference") % 3).cast("int"))
    s = segments.context_sequences(e, by=["reference"], order="_time", features=["probability"], length=5, tie=["event_id"])
    flat = sinks.written(models.flattened(s, 5).drop("sequence", "probability"), "sequences")  # all fits and scores read them
    bounds = flat.groupBy("fold", "reference").agg(F.min("_time").alias("start"), F.max("_time").alias("stop"))

    def train(f):
        return intervals.sequence_embargo(flat.where(F.col("fold") != f).drop("fold"), bounds.where(F.col("fold") == f), seconds=15)

    return _scored(models.out_of_fold(flat, models.sequence_classifier("target", 5), [0, 1, 2], train_on=train))


@query("m11_batch_scoring")
def m11(spark, sf_dir):
    """A fitted model is saved, read back and applied to all rows."""
    rows, names = _ml(spark, sf_dir)
    path = sinks.scratch_path(session(spark), "model")
    models.save(models.logistic(names, "target").fit(rows.where("fold <> 0")), path)
    return models.score(rows, models.load(path), threshold=0.6).groupBy("prediction_label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("walking_probability").alias("mean_probability"))


@query("m12_feature_importance")
def m12(spark, sf_dir):
    rows, names = _ml(spark, sf_dir)
    return models.importances(rows, models.random_forest(names, "target").fit(rows), names)


@query("m17_offset_sensitivity")
def m17(spark, sf_dir):
    """Labels shifted by up to two hours, as days stand for minutes here; a forest for each offset and fold of time blocks."""
    return models.sweep_offsets(_shifted_points(spark, sf_dir), labels(spark, sf_dir), ["p", "hour"], [-7200, -3600, 0, 3600, 7200], gap_s=43_200, embargo_s=15, trees=20, tie=["event_id"])


_OFFSETS = [-7200, -3600, -60, 0, 60, 3600, 7200]
_LEAVES = ", ".join(" + ".join(f"{2 ** (len(q) - 1 - i)} * CAST({'ph'[f]} > m{f} + ({z}) * s{f} AS INTEGER)" for i, (f, z) in enumerate(q)) for q in ferns.questions(2))
_LABELLED = f"""{LB}, pr AS (SELECT event_id, reference, _time, least(value / 200, 1.0) AS p, CAST(hour(_time) AS DOUBLE) AS h FROM ev WHERE value IS NOT NULL AND _time IS NOT NULL),
  fa AS (SELECT avg(p) AS m0, stddev_pop(p) AS s0, avg(h) AS m1, stddev_pop(h) AS s1 FROM pr),
  lo AS (SELECT o, pr.event_id, pr.reference, pr._time, pr.p, pr.h, arg_max(label, (start, stop, label)) = 'walking' AS y FROM pr CROSS JOIN (SELECT unnest({_OFFSETS}) AS o) JOIN lb ON lb.reference = pr.reference AND pr._time >= start + to_seconds(o) AND pr._time < stop + to_seconds(o) GROUP BY ALL),
  ga AS (SELECT *, CASE WHEN epoch_us(_time) - epoch_us(lag(_time) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS new FROM lo WINDOW w AS (PARTITION BY o, reference ORDER BY _time, event_id)),
  bl AS (SELECT *, sum(new) OVER (PARTITION BY o, reference ORDER BY _time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM ga),
  sp AS (SELECT o, reference, block, min(_time) - INTERVAL 15 SECOND AS low, max(_time) + INTERVAL 15 SECOND AS high FROM bl GROUP BY ALL)"""
_FERNS = f"""{_LABELLED}, le AS (SELECT bl.*, unnest([{_LEAVES}]) AS leaf, generate_subscripts([{_LEAVES}], 1) AS fern FROM bl, fa),
  al AS (SELECT o, fern, leaf, count(*) AS n, count_if(y) AS ones FROM le GROUP BY ALL),
  ou AS (SELECT le.o, le.reference, sp.block, fern, leaf, count(*) AS n_out, count_if(y) AS ones_out FROM le JOIN sp ON sp.o = le.o AND sp.reference = le.reference AND le._time >= low AND le._time <= high GROUP BY ALL),
  vo AS (SELECT ou.*, (1000000 * (ones - ones_out + 1)) // (n - n_out + 2) AS vote FROM ou JOIN al USING (o, fern, leaf)),
  sa AS (SELECT o, reference, block, event_id, y, sum(vote) AS said, count(*) AS n FROM le JOIN vo USING (o, reference, block, fern, leaf) GROUP BY ALL),
  co AS (SELECT CAST(o AS DOUBLE) AS offset_s, count(DISTINCT (reference, block)) AS blocks, {_COUNTS.format(y="CAST(y AS INTEGER)", h="said >= 125000 * n")} FROM sa GROUP BY 1)"""


def _shifted_points(spark, sf_dir):
    return predictions(spark, sf_dir).drop("target").withColumn("hour", F.hour("_time").cast("double")).withColumnRenamed("probability", "p")


@query("m17_block_offsets", f"WITH {_FERNS} SELECT offset_s, blocks, tp, fp, fn, tn, {_MET} FROM co")
def m17b(spark, sf_dir):
    """Labels shifted by up to two hours; every time block is left out in its turn, with an embargo of 15 seconds.
    About an eighth of the labelled rows walk, hence the threshold."""
    out = ferns.sweep_offsets(_shifted_points(spark, sf_dir), labels(spark, sf_dir), ["p", "hour"], _OFFSETS, gap_s=43_200, embargo_s=15, threshold=0.125, tie=["event_id"])
    return out.select("offset_s", "blocks", *_SHORT)


_MASKED = f"""{PR}, ga AS (SELECT *, CASE WHEN epoch_us(_time) - epoch_us(lag(_time) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS new FROM pr WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)),
  bl AS (SELECT *, CAST(sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block FROM ga),
  sp AS (SELECT reference, block, count(*) AS n_test, min(_time) - INTERVAL 36 HOUR AS low, max(_time) + INTERVAL 36 HOUR AS high FROM bl GROUP BY ALL),
  ou AS (SELECT sp.reference, sp.block, n_test, count(*) AS n_out, count_if(target = 1) AS ones_out FROM sp JOIN bl ON bl.reference = sp.reference AND _time >= low AND _time <= high GROUP BY ALL)"""


@query("m2_training_masks", f"WITH {_MASKED} SELECT reference, block, n_test, (SELECT count(*) FROM bl) - n_out AS n_train, (SELECT count_if(target = 1) FROM bl) - ones_out AS n_train_1 FROM ou")
def m2b(spark, sf_dir):
    """Every time block is a fold, rows within 36 hours of it don't teach it; rows carry masks and stand once."""
    rows = segments.gap_segments(predictions(spark, sf_dir), by=["reference"], time="_time", tie=["event_id"], gap_us=86_400 * times.SECOND, out="block")
    masked = folds.held_out(rows, by="reference", block="block", seconds=36 * 3600)
    return folds.training_sizes(masked, by="reference", block="block", target="target")


@query("m18_class_weight_sweep")
def m18(spark, sf_dir):
    rows, names = _ml(spark, sf_dir)
    return models.sweep_class_weights(rows, names, "target", weights=[{0: 1.0, 1: 1.0}, {0: 1.0, 1: 2.0}], thresholds=[0.4, 0.5], folds=[0, 1, 2], trees=10)


@query("f9_normalized_sequences", f"WITH {EV}, q AS (SELECT event_id, list(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM ev WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)), s AS (SELECT * FROM q WHERE len(l) = 3), m AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM (SELECT unnest(l) AS v FROM s WHERE event_id % 2 = 0)) SELECT event_id, (l[2] - m) / d AS center_value FROM s, m WHERE event_id % 2 = 1", "center_value")
def f9(spark, sf_dir):
    s = segments.context_sequences(events(spark, sf_dir), by=["reference"], order="_time", features=["value"], length=3, tie=["event_id"])
    n = models.normalized_sequences(s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1"), n_features=1)
    return n.select("event_id", F.col("sequence")[1][0].alias("center_value"))


@query("r12_train_validation", "SELECT lang IN ('de', 'fr') AS validation, count(*) AS n_rows FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def r12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    train, validation = folds.split_by_reference(d, d.where("lang in ('de', 'fr')"), by="lang")
    return train.withColumn("validation", F.lit(False)).unionByName(validation.withColumn("validation", F.lit(True))).groupBy("validation").agg(F.count(F.lit(1)).alias("n_rows"))


_STEP, _DAYS = 86_400_000_000, 4
_HOW = {"signals": ["v"], "step_us": _STEP, "window_us": _DAYS * _STEP, "hop_us": _STEP, "fs": 1.0, "fmax": 0.5, "limit": 3, "least": 0.2, "detrend": "constant", "scale": "density", "double_half": False}


def _spectrogram_sql(samples: str, requests: str, signals: str, least: float) -> str:
    """Windows of five daily bins in the time that both feet share, gaps of up to three bins filled, and their spectrum:
    sp (request_id, reference, foot, center_us, signal, completeness, bin, p). samples: reference, foot, _time, signal, v."""
    return f"""xs AS ({samples}), rq AS ({requests}), sg AS (SELECT unnest([{signals}]) AS signal),
  inq AS (SELECT rq.request_id, xs.* FROM xs JOIN rq ON rq.reference = xs.reference AND _time >= rq.start AND _time < rq.stop WHERE foot IS NOT NULL),
  bn AS (SELECT request_id, reference, foot, signal, epoch_us(_time) // {_STEP} * {_STEP} AS t, avg(v) AS v FROM inq GROUP BY ALL),
  bo AS (SELECT request_id, reference, foot, min(t) AS lo, max(t) AS hi FROM bn GROUP BY ALL), gd AS (SELECT request_id, reference, foot, signal, unnest(range(lo, hi + 1, {_STEP})) AS t FROM bo, sg),
  gr AS (SELECT gd.*, v, row_number() OVER (PARTITION BY gd.request_id, gd.foot, gd.signal ORDER BY t) AS i FROM gd LEFT JOIN bn USING (request_id, reference, foot, signal, t)),
  ed AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS li, last_value(v IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ri, first_value(v IGNORE NULLS) OVER a AS rv FROM gr
    WINDOW b AS (PARTITION BY request_id, foot, signal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY request_id, foot, signal ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  fl AS (SELECT request_id, reference, foot, signal, t, v IS NOT NULL AS seen, coalesce(v, CASE WHEN i - li <= 3 AND ri IS NOT NULL THEN lv + (rv - lv) * (i - li) / (ri - li) END) AS v FROM ed),
  cm AS (SELECT request_id, max(lo) AS lo, min(hi) AS hi FROM bo GROUP BY 1 HAVING count(*) = 2),
  ct AS (SELECT request_id, unnest(range(greatest(lo, epoch_us(start)) + {2 * _STEP}, least(hi, epoch_us(stop)) - {2 * _STEP} + 1, {_STEP})) AS center_us FROM cm JOIN rq USING (request_id)),
  wn AS (SELECT fl.*, center_us, row_number() OVER (PARTITION BY request_id, foot, signal, center_us ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY request_id, foot, signal, center_us) AS n FROM fl JOIN ct USING (request_id) WHERE t BETWEEN center_us - {2 * _STEP} AND center_us + {2 * _STEP}),
  cp AS (SELECT request_id, foot, center_us, count(*) FILTER (seen) / (5.0 * max(m)) AS completeness FROM wn, (SELECT count(*) AS m FROM sg) WHERE n = 5 GROUP BY request_id, foot, center_us HAVING count(*) FILTER (seen) / (5.0 * max(m)) >= {least}),
  wh AS (SELECT request_id, foot, signal, center_us, avg(v) AS mean FROM wn GROUP BY ALL HAVING count(v) = 5),
  yy AS (SELECT wn.*, completeness, (v - mean) * (0.5 - 0.5 * cos(2 * pi() * j / 5)) AS y FROM wn JOIN cp USING (request_id, foot, center_us) JOIN wh USING (request_id, foot, signal, center_us)),
  tw AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 5), 2)) AS w FROM (SELECT unnest(range(0, 5)) AS i)),
  sp AS (SELECT request_id, reference, foot, center_us, signal, completeness, k AS bin, max(CASE WHEN k = 0 THEN 1 ELSE 2 END / w) * (pow(sum(y * cos(2 * pi() * k * j / 5)), 2) + pow(sum(y * sin(2 * pi() * k * j / 5)), 2)) AS p FROM yy, (SELECT unnest(range(0, 3)) AS k), tw GROUP BY request_id, reference, foot, center_us, signal, completeness, k)"""


def _samples(spark, sf_dir):
    """Events of all kinds stand for a foot, half of the kinds each, so that both feet have samples on most days."""
    e = events(spark, sf_dir)
    return e.select("event_id", "reference", F.when(F.col("event_id") % 2 == 0, "Left").otherwise("Right").alias("foot"), "_time", F.col("value").alias("v"))


_SAMPLES = "SELECT reference, CASE WHEN event_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS foot, _time, 'v' AS signal, value AS v FROM ev"


def _windows_asked(spark, sf_dir):
    """A window table: the labelled span of each reference; of every fifth reference a long negative, not for training."""
    r = pipelines.requests_of(labels(spark, sf_dir))
    return r.withColumn("label", F.when(F.col("reference") % 5 == 0, "not_walking").otherwise("walking"))


_ASKED = "SELECT reference AS request_id, reference, min(start) AS start, max(stop) AS stop FROM lb GROUP BY reference HAVING NOT (reference % 5 = 0 AND epoch_us(max(stop)) - epoch_us(min(start)) > 600000000)"
_WIDE = ", ".join(f'max(p) FILTER (foot = \'{f}\' AND bin = {k}) AS "{f}_v_p_00{k}"' for f in ("Left", "Right") for k in range(3))
_WIDE_NAMES = [f"{f}_v_p_00{k}" for f in ("Left", "Right") for k in range(3)]
_WHOLE = " AND ".join(f'"{c}" IS NOT NULL' for c in _WIDE_NAMES)


@query("c1_main_dataset", f"""WITH {LB}, {_spectrogram_sql(_SAMPLES, _ASKED, "'v'", 0.2)},
  lc AS (SELECT sp.reference, center_us, foot, bin, p, arg_min(l.label, (l.start, l.stop, l.label)) AS mov_type FROM sp JOIN lb l ON l.reference = sp.reference AND make_timestamp(center_us) >= l.start AND make_timestamp(center_us) < l.stop GROUP BY ALL),
  wd AS (SELECT reference, center_us, mov_type, {_WIDE} FROM lc GROUP BY 1, 2, 3) SELECT *, CASE mov_type WHEN 'walking' THEN 1 ELSE 0 END AS target FROM wd WHERE {_WHOLE}""", " ".join(f'"{c}"' for c in _WIDE_NAMES))
def c1(spark, sf_dir):
    out = pipelines.main_dataset(_samples(spark, sf_dir), _windows_asked(spark, sf_dir), labels(spark, sf_dir), **_HOW)
    return out.select("reference", "center_us", "mov_type", *_WIDE_NAMES, "target")


@query("c2_reproduce_evaluation")
def c2(spark, sf_dir):
    path = sinks.scratch_path(session(spark), "final-model")
    return pipelines.reproduce(_samples(spark, sf_dir), labels(spark, sf_dir), path, trees=30, leaf=2, **_HOW)


_TILES = """ti AS (SELECT label_id, reference, tile, start + INTERVAL 1 DAY * (2 * tile) AS start, start + INTERVAL 1 DAY * (2 * tile + 2) AS stop FROM (SELECT *, unnest(range(0, 2)) AS tile FROM lb)),
  tc AS (SELECT ti.label_id, ti.tile, ti.reference, ti.start, ti.stop, count(*) FILTER (foot = 'Left') AS l, count(*) FILTER (foot = 'Right') AS r FROM ti LEFT JOIN es ON es.reference = ti.reference AND es._time >= ti.start AND es._time < ti.stop GROUP BY ALL),
  tq AS (SELECT *, least(l, r) >= 2 AS ok, row_number() OVER w AS scan_rank, coalesce(sum(CASE WHEN least(l, r) >= 2 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tc WINDOW w AS (PARTITION BY reference ORDER BY label_id, tile)),
  tv AS (SELECT * FROM tq WHERE ok AND scan_rank <= 6 AND before < 2)"""
_AUTO = """en AS (SELECT tv.label_id, tv.tile, tv.reference, foot, time_bucket(INTERVAL 6 HOUR, _time, TIMESTAMP '1970-01-01') AS ws, coalesce(stddev_samp(value), 0) AS energy, count(*) AS samples FROM tv JOIN es ON es.reference = tv.reference AND es._time >= tv.start AND es._time < tv.stop GROUP BY ALL),
  md AS (SELECT label_id, tile, quantile_cont(energy, 0.5) AS med, avg(energy) AS av, stddev_pop(energy) AS sd FROM en GROUP BY ALL), ma AS (SELECT label_id, tile, quantile_cont(abs(energy - med), 0.5) AS mad FROM en JOIN md USING (label_id, tile) GROUP BY ALL),
  sc AS (SELECT en.*, greatest(0, CASE WHEN mad > 0 THEN (energy - med) / (1.4826 * mad) WHEN sd > 0 THEN (energy - av) / sd ELSE 0 END) AS score FROM en JOIN md USING (label_id, tile) JOIN ma USING (label_id, tile)),
  ms AS (SELECT label_id, tile, reference, ws, avg(score) AS score, count(DISTINCT foot) AS feet FROM sc GROUP BY ALL),
  th AS (SELECT label_id, tile, quantile_cont(score, 0.35) AS low, CASE WHEN quantile_cont(score, 0.75) <= quantile_cont(score, 0.35) THEN max(score) ELSE quantile_cont(score, 0.75) END AS high FROM ms GROUP BY ALL),
  cw AS (SELECT ms.*, CASE WHEN round(score, 8) >= round(high, 8) THEN 'walking' WHEN round(score, 8) <= round(low, 8) THEN 'not_walking' END AS label FROM ms JOIN th USING (label_id, tile)),
  cn AS (SELECT *, CASE WHEN lag(label) OVER w = label AND epoch_us(ws) - epoch_us(lag(ws) OVER w) <= 32400000000 THEN 0 ELSE 1 END AS new FROM cw WHERE label IS NOT NULL WINDOW w AS (PARTITION BY label_id, tile ORDER BY ws)),
  cs AS (SELECT *, sum(new) OVER (PARTITION BY label_id, tile ORDER BY ws) AS segment FROM cn),
  ac AS (SELECT reference, min(label) AS label, min(ws) AS start, max(ws) + INTERVAL 6 HOUR AS stop FROM cs GROUP BY label_id, tile, reference, segment HAVING epoch_us(max(ws)) - epoch_us(min(ws)) + 21600000000 >= 36000000000 AND min(feet) >= 1)"""


@query("c4_label_extension", f"""WITH {LB}, es AS (SELECT event_id, reference, CASE WHEN event_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS foot, _time, value FROM ev), {_TILES}, {_AUTO},
  ba AS (SELECT e.event_id, e.reference, e._time, arg_min(l.label, (l.start, l.stop, l.label)) AS label FROM es e JOIN lb l ON e.reference = l.reference AND e._time >= l.start AND e._time < l.stop GROUP BY ALL),
  au AS (SELECT e.event_id, e.reference, e._time, arg_max(l.label, (l.start, l.stop, l.label)) AS label FROM es e JOIN ac l ON e.reference = l.reference AND e._time >= l.start AND e._time < l.stop GROUP BY ALL)
  SELECT *, 'base' AS dataset_source FROM ba UNION ALL SELECT *, 'auto' FROM au WHERE event_id NOT IN (SELECT event_id FROM ba)""")
def c4(spark, sf_dir):
    l = labels(spark, sf_dir)  # noqa: E741
    candidates = l.withColumn("stop", F.col("start") + F.expr("INTERVAL 4 DAYS"))
    samples = _samples(spark, sf_dir).withColumnRenamed("v", "value")
    out = pipelines.label_extension(samples, l, candidates, tile_s=172_800, least_records=2, most_valid=2, most_scanned=6, window_us=21_600_000_000, least_s=36_000, feet=1)
    return out.select("event_id", "reference", "_time", "label", "dataset_source")


@query("c5_correction_audit", f"""WITH {PR}, {_POLL}, pl AS (SELECT pp.*, reference, _time FROM pp JOIN pr USING (event_id)),
  gn AS (SELECT *, CASE WHEN lag(proposed) OVER w = proposed AND epoch_us(_time) - epoch_us(lag(_time) OVER w) <= 172800000000 THEN 0 ELSE 1 END AS new FROM pl WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)),
  gr AS (SELECT *, sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS run FROM gn),
  ru AS (SELECT reference, run, proposed, min(_time) AS run_start, max(_time) AS run_end, count(*) AS n_windows, max(max_probability) AS mp FROM gr GROUP BY ALL ORDER BY n_windows DESC, mp DESC, reference, run_start LIMIT 40),
  ft AS (SELECT ru.reference, run, ru.proposed, run_start, run_end, foot, stddev_samp(value) AS s FROM ru JOIN (SELECT reference, CASE WHEN event_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS foot, _time, value FROM ev) e ON e.reference = ru.reference AND e._time BETWEEN run_start AND run_end GROUP BY ALL),
  de AS (SELECT reference, proposed, run_start, run_end, (proposed = 1 AND avg(s) >= 25) OR (proposed = 0 AND avg(s) <= 40) AS confirm FROM ft GROUP BY reference, run, proposed, run_start, run_end),
  jd AS (SELECT event_id, pl.proposed, bool_or(coalesce(confirm, FALSE)) AS confirm FROM pl JOIN de ON de.reference = pl.reference AND de.proposed = pl.proposed AND pl._time BETWEEN run_start AND run_end GROUP BY ALL)
  SELECT pr.event_id, CAST(CASE WHEN confirm THEN jd.proposed ELSE target END AS INTEGER) AS target, CASE WHEN (CASE WHEN confirm THEN jd.proposed ELSE target END) = 1 THEN 'walking' ELSE 'not_walking' END AS mov_type, coalesce(confirm, FALSE) AS corrected, jd.proposed AS asked, CASE WHEN confirm THEN 'confirm' WHEN confirm IS NOT NULL THEN 'leave' END AS decision FROM pr LEFT JOIN jd USING (event_id)""")
def c5(spark, sf_dir):
    p = predictions(spark, sf_dir)
    data = p.select("event_id", "reference", "_time", "target", lab.label_of(F.col("target")).alias("mov_type"))
    samples = _samples(spark, sf_dir).withColumnRenamed("v", "value")
    out = pipelines.correction_audit(data, _poll(spark, sf_dir), samples, key="event_id", high=0.5, low=0.2, top=40, gap_us=2 * _STEP, moving=25, still=40)
    return out.select("event_id", "target", "mov_type", "corrected", "asked", "decision")


_CHOSEN = "ch AS (SELECT reference, row_number() OVER (ORDER BY n DESC, reference) AS order_index FROM (SELECT reference, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) >= 8))"


def _chosen(spark, sf_dir):
    s = events(spark, sf_dir).where("event_type = 'signup'").groupBy("reference").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    return s.withColumn("order_index", F.row_number().over(Window.orderBy(F.desc("n"), "reference"))).select("reference", "order_index")  # a row for each reference


@query("c6_sequence_evaluation", f"""WITH {LB}, {_CHOSEN}, l AS (SELECT e.event_id, e.reference, e._time, least(e.value / 200, 1.0) AS probability, arg_min(l.label, (l.start, l.stop, l.label)) AS label FROM ev e JOIN lb l ON e.reference = l.reference AND e._time >= l.start AND e._time < l.stop GROUP BY ALL),
  x AS (SELECT l.*, probability >= 0.1 AS flag, row_number() OVER (ORDER BY order_index, _time, event_id) AS position FROM l JOIN ch USING (reference)),
  y AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY reference ORDER BY _time, event_id)), z AS (SELECT *, sum(new) OVER (PARTITION BY reference ORDER BY _time, event_id) AS run FROM y),
  h AS (SELECT *, flag AND count(*) OVER (PARTITION BY reference, run) >= 2 AS smooth, CASE label WHEN 'walking' THEN 1 ELSE 0 END AS target FROM z), s AS (SELECT *, unnest(['raw', 'smoothed']) AS stage FROM h),
  c AS (SELECT reference, stage, min(position) AS first_position, max(position) AS last_position, {_COUNTS.format(y='target', h="CASE stage WHEN 'raw' THEN flag ELSE smooth END")} FROM s GROUP BY 1, 2)
  SELECT reference, stage, first_position, last_position, tp, fp, fn, tn, {_MET} FROM c""")
def c6(spark, sf_dir):
    out = pipelines.sequence_evaluation(predictions(spark, sf_dir).drop("target"), labels(spark, sf_dir), _chosen(spark, sf_dir), threshold=0.1, min_run=2)
    return out.select("reference", "stage", "first_position", "last_position", *_SHORT)


@query("c6_scored_evaluation")
def c6b(spark, sf_dir):
    """The same with a model's own scores: fitted on half of the references, saved, read back, applied to all rows."""
    rows = events(spark, sf_dir).select("event_id", "reference", "_time", "value", F.hour("_time").cast("double").alias("hour"))
    known = intervals.label_points(rows, labels(spark, sf_dir)).where("label <> 'NO_LABEL' and reference % 2 = 0").withColumn("target", lab.target(F.col("label")).cast("int"))
    path = sinks.scratch_path(session(spark), "model")
    models.save(models.logistic(["value", "hour"], "target").fit(known), path)
    scored = pipelines.scored(rows, models.load(path), threshold=0.5).select("event_id", "reference", "_time", "probability")
    return pipelines.sequence_evaluation(scored, labels(spark, sf_dir), _chosen(spark, sf_dir), threshold=0.5, min_run=2).select("reference", "stage", *_SHORT)


def _bundle(spark, sf_dir):
    """Bundle rows: two signals, times cut to the second. Values have two decimals, whose means end in exact halves at the
    last digit that is compared; scaled by a tenth of pi they don't."""
    e = _samples(spark, sf_dir).withColumn("v", F.col("v") * 0.3141592653589793)
    return e.select("reference", "foot", F.when(F.col("event_id") % 3 == 0, "Gx").otherwise("Ax").alias("signal"), F.col("event_id").alias("sample_order"), F.date_trunc("second", "_time").alias("_time"), F.col("v").alias("value"))


_BUNDLE = """SELECT reference, foot, make_timestamp(us) AS _time, signal, avg(v) AS v FROM (SELECT reference, foot, signal, v, epoch_us(sec) + (row_number() OVER (PARTITION BY reference, foot, signal, sec ORDER BY event_id) - 1) * 1000000 // count(*) OVER (PARTITION BY reference, foot, signal, sec) AS us
  FROM (SELECT event_id, reference, CASE WHEN event_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS foot, CASE WHEN event_id % 3 = 0 THEN 'Gx' ELSE 'Ax' END AS signal, date_trunc('second', _time) AS sec, value * CAST(0.3141592653589793 AS DOUBLE) AS v FROM ev)) GROUP BY ALL"""
_SPANS = "SELECT reference AS request_id, reference, min(start) AS start, max(stop) AS stop FROM lb GROUP BY reference"
_BUNDLE_HOW = _HOW | {"signals": ["Ax", "Gx"], "least": 0.03}
_FIVE = f"""{LB}, {_spectrogram_sql(_BUNDLE, _SPANS, "'Ax', 'Gx'", 0.03)},
  f5 AS (SELECT request_id, reference, foot, center_us, completeness, s.signal, 'not_walking' AS mov_type, coalesce(max(p) FILTER (bin = 0 AND sp.signal = s.signal), 0.0) AS p_000, coalesce(max(p) FILTER (bin = 1 AND sp.signal = s.signal), 0.0) AS p_001, coalesce(max(p) FILTER (bin = 2 AND sp.signal = s.signal), 0.0) AS p_002 FROM sp, sg s GROUP BY ALL)"""


@query("f5_bundle_spectrogram", f"WITH {_FIVE} SELECT * FROM f5", "completeness p_000 p_001 p_002")
def f5(spark, sf_dir):
    spans = pipelines.requests_of(labels(spark, sf_dir)).select("request_id", "reference", "start", "stop")
    out = extraction.bundle_spectrogram(_bundle(spark, sf_dir), spans, **_BUNDLE_HOW)
    return out.select("request_id", "reference", "foot", "center_us", "completeness", "signal", "mov_type", "p_000", "p_001", "p_002")


_HARD = [f"{f}_{s}_p_00{k}" for f in ("Left", "Right") for s in ("Ax", "Gx") for k in range(3)]
_HARD_SQL = ", ".join(f"max(p_00{k}) FILTER (foot = '{f}' AND signal = '{s}') AS \"{f}_{s}_p_00{k}\"" for f in ("Left", "Right") for s in ("Ax", "Gx") for k in range(3))


@query("c3_hard_negatives", f"WITH {_FIVE}, w AS (SELECT reference, center_us, mov_type, {_HARD_SQL} FROM f5 GROUP BY 1, 2, 3) SELECT *, 0 AS target FROM w WHERE {' AND '.join(chr(34) + c + chr(34) + ' IS NOT NULL' for c in _HARD)}", " ".join(f'"{c}"' for c in _HARD))
def c3(spark, sf_dir):
    spans = pipelines.requests_of(labels(spark, sf_dir)).select("request_id", "reference", "start", "stop")
    return pipelines.hard_negatives(_bundle(spark, sf_dir), spans, **_BUNDLE_HOW).select("reference", "center_us", "mov_type", *_HARD, "target")


def _streamed(spark, sf_dir, make):
    """The rows that a stateless streaming query over the events, a file at a time, has written to a table of files."""
    spark = session(spark)
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", 4)
    out, path = make(_shaped(source.parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, sf_dir) else f"{sf_dir}/events*.parquet"))), sinks.scratch_path(spark, "stream")
    replay.append(out, path)
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def _shaped(e):
    return e.select("event_id", F.col("user_id").cast("string").alias("reference"), F.col("event_type").alias("foot"), F.col("ts").cast("timestamp").alias("_time"), "value")


def _in_order(spark, sf_dir, make, close=None, run=replay.append):
    """The events through a stream, one slice of time after the other, a slice for every four files (at most 256).
    close: from the shaped events to the rows that close what is open at the end."""
    spark = session(spark)
    e = _shaped(table(spark, sf_dir, "events")).withColumn("end", F.lit(False))
    n = min(max(-(-len(spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()) // 4), 1), 256)
    return replay.in_time_order(e, make, sinks.scratch_path(spark, "stream"), slices=n, closing=close(e) if close else None, run=run)[0]


def _only(e, **values):
    """Columns of e: those that are named, all others null."""
    return [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema.fields]


def _after_all(size_s):
    """One row that lies behind all others by more than size_s. Its own window never closes."""
    return lambda e: e.agg(F.max("_time").alias("high")).where("high IS NOT NULL").select(*_only(e, _time=F.timestamp_micros(F.unix_micros("high") + (size_s + 2) * 1_000_000)))


def _is_folder(spark, sf_dir) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("x1_stream_dedup", "SELECT user_id || '' AS reference, event_type AS foot, count(DISTINCT ts) AS n_rows FROM events GROUP BY 1, 2")
def x1(spark, sf_dir):
    rows = _in_order(spark, sf_dir, lambda e: live.dedup_samples(e.unionByName(e), ["reference", "foot", "_time"], late=replay.NO_DELAY))
    return rows.groupBy("reference", "foot").agg(F.count(F.lit(1)).alias("n_rows"))


@query("x2_stream_energy", "SELECT user_id || '' AS reference, event_type AS foot, date_trunc('day', ts) AS window_start, coalesce(stddev_samp(value), 0) AS energy, count(*) AS samples FROM events GROUP BY 1, 2, 3", "energy")
def x2(spark, sf_dir):
    return _in_order(spark, sf_dir, lambda e: live.motion_energy(e, by=["reference", "foot"], value="value", window="1 day", late=replay.NO_DELAY), _after_all(86_400))


@query("x3_stream_sliding", "SELECT event_type AS foot, w AS window_start, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2", "mean std min max")
def x3(spark, sf_dir):
    return _in_order(spark, sf_dir, lambda e: live.sliding_statistics(e, by=["foot"], value="value", size="2 days", slide="1 day", late=replay.NO_DELAY), _after_all(2 * 86_400))


@query("x4_stream_sessions", "WITH n AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM n) SELECT user_id || '' AS reference, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k")
def x4(spark, sf_dir):
    return _in_order(spark, sf_dir, lambda e: live.activity_sessions(e, by=["reference"], gap="12 hours", late=replay.NO_DELAY), _after_all(43_200))


@query("x5_stream_labels", "WITH f AS (SELECT user_id, min(ts) AS start, min(ts) + INTERVAL 5 DAY AS stop FROM events GROUP BY 1) SELECT CASE WHEN ts < stop THEN 'walking' ELSE 'NO_LABEL' END AS label, count(*) AS n_rows FROM events JOIN f USING (user_id) GROUP BY 1")
def x5(spark, sf_dir):
    first = events(spark, sf_dir).groupBy(F.col("reference").cast("string").alias("reference")).agg(F.min("_time").alias("start"))
    l = first.select("reference", "start", (F.col("start") + F.expr("INTERVAL 5 DAYS")).alias("stop"), F.lit("walking").alias("label"))  # noqa: E741
    return _streamed(spark, sf_dir, lambda e: live.label_stream(e, l)).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("x6_stream_hysteresis", f"WITH RECURSIVE {PR}, {_HYST.format(grid='(0.1, 0.05, 2, 2)', k1=1, m1=1)} SELECT reference || '' AS reference, _time, probability, state FROM hy", "probability")
def x6(spark, sf_dir):
    return _in_order(spark, sf_dir, lambda e: live.live_hysteresis(e.withColumn("probability", F.least(F.col("value") / 200, F.lit(1.0))), key="reference", time="_time", hi=0.1, lo=0.05, k=2, m=2, tie=["event_id"], end="end"), lambda e: e.select("reference").distinct().select(*_only(e, reference=F.col("reference"), end=F.lit(True))))


@query("x7_stream_coverage", "SELECT user_id || '' AS reference, event_type AS foot, count(*) AS n_rows FROM events GROUP BY 1, 2")
def x7(spark, sf_dir):
    rows = _in_order(spark, sf_dir, lambda e: live.live_coverage(e, window="1 day", late=replay.NO_DELAY), run=replay.update)
    last = rows.groupBy("reference", "foot", "window_start").agg(F.max("n_rows").alias("n_rows"))
    return last.groupBy("reference", "foot").agg(F.sum("n_rows").alias("n_rows"))


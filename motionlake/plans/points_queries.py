"""Queries over scans, projections and normal forms (S, P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motionlake.functions import contracts, times
from motionlake.functions import labels as lab
from motionlake.operators import autolabel, features, reshape, selection
from motionlake.plans.common import EV, EX, LB, events, exclusions, labels, predictions, query, session, table
from motionlake.sources import points, sinks


def _points(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "reference", F.when(F.col("event_id") % 2 == 0, "Left").otherwise("Right").alias("foot"), "_time", F.col("event_type").alias("field"), "value")


_PT = EV + ", pt AS (SELECT event_id, reference, CASE WHEN event_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS foot, _time, event_type AS field, value FROM ev)"


@query("s1_scan_points", f"WITH {LB}, {_PT[len(EV) + 2:]} SELECT p.reference, l.label_id, p.foot, p._time, p.field, p.value FROM pt p JOIN lb l ON p.reference = l.reference AND p._time >= l.start AND p._time < l.stop WHERE field IN ('view', 'click')", "value")
def s1(spark, sf_dir):
    found = points.scan_points(_points(spark, sf_dir), labels(spark, sf_dir).drop("label"), fields=["view", "click"])
    return found.select("reference", "label_id", "foot", "_time", "field", "value")


@query("s2_pivot_fields", f"WITH {_PT} SELECT reference, foot, date_trunc('hour', _time) AS _time, min(value) FILTER (field = 'view') AS view, min(value) FILTER (field = 'click') AS click FROM pt GROUP BY 1, 2, 3", "view click")
def s2(spark, sf_dir):
    return points.pivot_fields(_points(spark, sf_dir).withColumn("_time", F.date_trunc("hour", "_time")), ["view", "click"])


@query("s3_normalize_samples", f"WITH {_PT} SELECT reference, foot, date_trunc('hour', _time) AS _time, arg_min(value, event_id) AS \"Ax\" FROM pt GROUP BY 1, 2, 3", '"Ax"')
def s3(spark, sf_dir):
    rows = _points(spark, sf_dir).select("event_id", "reference", "foot", F.date_trunc("hour", "_time").alias("_time"), F.col("value").alias("Ax"))
    return points.normalize_samples(rows, tie="event_id")


@query("s4_raw_extract", f"""WITH {LB}, {_PT[len(EV) + 2:]} SELECT p.reference, p.foot, p._time, min(value) FILTER (field = 'view') AS view, min(value) FILTER (field = 'click') AS click,
  strftime(start, '%Y-%m-%d %H:%M:%S') AS from_local, strftime(stop, '%Y-%m-%d %H:%M:%S') AS until_local, 'UTC' AS timezone,
  strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS from_utc, strftime(stop, '%Y-%m-%dT%H:%M:%SZ') AS until_utc
  FROM pt p JOIN lb l ON p.reference = l.reference AND p._time >= l.start AND p._time < l.stop WHERE field IN ('view', 'click') GROUP BY p.reference, p.foot, p._time, start, stop""", "view click")
def s4(spark, sf_dir):
    return points.raw_extract(_points(spark, sf_dir), labels(spark, sf_dir).select("reference", "start", "stop"), fields=["view", "click"])


@query("s5_pruned_read", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY 1, 2")
def s5(spark, sf_dir):
    return points.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s7_bundle_rows", """WITH c AS (SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END, chr(10) ORDER BY event_id) AS body FROM events WHERE event_type = 'view' GROUP BY user_id),
  r AS (SELECT user_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS sample_order FROM c)
  SELECT 'P001' AS reference, CASE WHEN user_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS foot, 'Ax' AS signal, 'Ax channel 1' AS raw_channel_name,
  CASE WHEN user_id % 2 = 0 THEN 'left_' ELSE 'right_' END || user_id || '.csv' AS source_file, sample_order, string_split(line, ',')[1] AS time, try_cast(string_split(line, ',')[2] AS DOUBLE) AS value FROM r""", "value")
def s7(spark, sf_dir):
    """Single-signal CSV texts, built from the events of a user, read back as rows."""
    number = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    line = F.concat(F.date_format("_time", "yyyy-MM-dd HH:mm:ss"), F.lit(","), number)
    rows = events(spark, sf_dir).where("event_type = 'view'").groupBy("reference").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("﻿Time,Ax channel 1\r\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\r\n"))
    name = F.concat(F.when(F.col("reference") % 2 == 0, "left_").otherwise("right_"), F.col("reference").cast("string"), F.lit(".csv"))
    return points.bundle_rows(rows.select(name.alias("source_file"), text.alias("content")), reference="P001")


@query("s8_bundle_manifest", f"WITH {EV} SELECT reference, event_type, count(*) AS n_rows, count(DISTINCT _time) AS distinct_times, min(_time) AS first_time, max(_time) AS last_time, min(value) AS min_value, max(value) AS max_value FROM ev GROUP BY 1, 2", "min_value max_value")
def s8(spark, sf_dir):
    return points.bundle_manifest(events(spark, sf_dir), ["reference", "event_type"], "_time")


@query("s9_multi_file_read", "SELECT t, count(*) AS n_rows FROM (SELECT 'events' AS t FROM events UNION ALL SELECT 'labels' FROM labels) GROUP BY t")
def s9(spark, sf_dir):
    found = points.read_files(spark, [f"{sf_dir}/events.parquet"], ["event_id"]).unionByName(points.read_files(spark, [f"{sf_dir}/labels.parquet"], ["doc_id"]).withColumnRenamed("doc_id", "event_id"))
    return found.withColumn("t", F.regexp_extract("source_file", r"([a-z]+)\.parquet", 1)).groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s13_audit_record", f"WITH {EV}, f AS (SELECT foot, count(*) AS n FROM ev WHERE foot IS NOT NULL GROUP BY foot) SELECT 'ok' AS status, CAST(sum(n) AS BIGINT) AS n_rows, max(n) FILTER (foot = 'Left') AS left_rows, max(n) FILTER (foot = 'Right') AS right_rows FROM f")
def s13(spark, sf_dir):
    from motionlake.sources.sinks import audit_record

    r = audit_record(events(spark, sf_dir).where("foot is not null"), "ok")
    return r.select("status", F.col("counters.rows").alias("n_rows"), F.col("feet")["Left"]["rows"].alias("left_rows"), F.col("feet")["Right"]["rows"].alias("right_rows"))


@query("s14_pending_requests", f"WITH {EX}, q AS (SELECT event_id, reference, CAST(CAST(_time AS DATE) AS VARCHAR) AS day FROM ev WHERE event_type = 'signup') SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.reference = q.reference AND CAST(CAST(ex.start AS DATE) AS VARCHAR) = q.day)")
def s14(spark, sf_dir):
    e = events(spark, sf_dir)
    asked = e.where("event_type = 'signup'").select("event_id", "reference", F.to_date("_time").cast("string").alias("day"))
    done = e.where("event_type = 'error'").select("reference", F.to_date("_time").cast("string").alias("day"))
    return points.pending(asked, done, ["reference", "day"]).select("event_id", "reference", "day")


_SUNDAY = "make_timestamp(year(d), {m}, {l}, 1, 0, 0) - INTERVAL 1 DAY * dayofweek(make_date(year(d), {m}, {l}))"  # the last of the month, 1:00
#: When summer time begins and ends; up to 1995 it ended in September.
_SPRING = _SUNDAY.format(m=3, l=31)
_AUTUMN = f"CASE WHEN year(d) < 1996 THEN {_SUNDAY.format(m=9, l=30)} ELSE {_SUNDAY.format(m=10, l=31)} END"


@query("p1_time_texts", f"WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS d FROM orders) SELECT o_orderkey, d + CASE WHEN d >= {_SPRING} AND d < {_AUTUMN} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS local_time, strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, strftime(d, '%Y%m%dT%H%M%S') AS compact FROM o")
def p1(spark, sf_dir):
    """Dates get a time of day, so that hours around the clock changes occur."""
    o = table(spark, sf_dir, "orders")
    d = times.from_micros(times.micros("o_orderdate") + (F.col("o_orderkey") % 1440) * 60 * times.SECOND)
    return o.select("o_orderkey", times.to_local(d, "Europe/Madrid").alias("local_time"), times.rfc3339(d).alias("rfc3339"), times.compact(d).alias("compact"))


@query("p2_parse_mixed", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate END AS parsed FROM orders")
def p2(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, " yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "dd/MM/yyyy")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.parse_mixed(text).alias("parsed"))


@query("p3_aliases", "SELECT p_brand AS reference, count(*) AS n_rows FROM part GROUP BY 1")
def p3(spark, sf_dir):
    return contracts.aliased(table(spark, sf_dir, "part"), {"reference": ("Reference", "ref", "p_brand")}).groupBy("reference").agg(F.count(F.lit(1)).alias("n_rows"))


@query("p4_label_contract", "SELECT count(*) FILTER (toxic <> quality) AS contradictions, count(*) FILTER (toxic IS NULL) AS null_targets, count(*) AS n_rows FROM labels")
def p4(spark, sf_dir):
    rows = contracts.require_columns(table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return contracts.violations(rows.select(F.col("toxic").alias("target"), lab.label_of(F.col("quality")).alias("mov_type")))


@query("p5_label_forms", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'walking' WHEN 1 THEN 'not_walking' WHEN 2 THEN NULL WHEN 3 THEN 'invalid:' || event_type ELSE 'walking' END AS label, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 4 THEN 1 END AS target FROM events")
def p5(spark, sf_dir):
    k = F.col("event_id") % 5
    text = F.when(k == 0, " Walk ").when(k == 1, "NOT WALKING").when(k == 2, "  ").when(k == 3, F.upper("event_type")).otherwise("walking")
    return events(spark, sf_dir).select("event_id", lab.normalized(text).alias("label")).select("event_id", "label", lab.target(F.col("label")).cast("int").alias("target"))


@query("p6_target_from_label", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN toxic END, quality) AS target, CASE quality WHEN 1 THEN 'walking' ELSE 'not_walking' END AS mov_type FROM labels")
def p6(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("toxic")).alias("target"), lab.label_of(F.col("quality")).alias("mov_type"))
    return lab.with_target(rows).withColumn("target", F.col("target").cast("int"))


@query("p7_complete_rows", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 45 AND l_discount > 0", "l_quantity")
def p7(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 45, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_discount") > 0, 1).alias("_d"))
    return reshape.complete_rows(rows).drop("_d")


@query("p8_durations", "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate - o_orderdate) / 1000000.0 AS duration_s, round(epoch_us(l_shipdate - o_orderdate) / 60000000.0, 6) AS duration_min FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate", "duration_s duration_min")
def p8(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = rows.select("l_orderkey", "l_linenumber", times.seconds_between("o_orderdate", "l_shipdate").alias("duration_s"), times.minutes_between("o_orderdate", "l_shipdate").alias("duration_min"))
    return made.where("duration_s > 0")


@query("p9_magnitude", "SELECT l_orderkey, l_linenumber, sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS acc FROM lineitem", "acc")
def p9(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "Ax", "l_discount": "Ay", "l_tax": "Az"})  # noqa: E741
    return features.magnitude(l, "A", "acc").select("l_orderkey", "l_linenumber", "acc")


@query("p10_accept_suggestions", f"WITH {LB} SELECT label_id, label AS mov_type, 'auto' AS label_quality FROM lb WHERE label_id % 3 > 0 AND label_id % 2 + 1 >= 2 AND 1000 + label_id % 10 >= 1004")
def p10(spark, sf_dir):
    rows = labels(spark, sf_dir).withColumns({"label": F.when(F.col("label_id") % 3 > 0, F.col("label")).otherwise("unknown"), "feet_min": F.col("label_id") % 2 + 1, "duration_s": 1000 + F.col("label_id") % 10, "mean_score": F.lit(1.0)})
    return autolabel.accept(rows, 1004).select("label_id", "mov_type", "label_quality")


@query("p11_select_segments", f"WITH {EX}, s AS (SELECT event_id, reference, _time AS from_time FROM ev WHERE event_type = 'signup') SELECT event_id, reference FROM s WHERE event_id % 4 > 0 AND event_id % 5 < 3 AND event_id % 2 = 0")
def p11(spark, sf_dir):
    s = events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "reference", F.col("_time").alias("from_time"), (F.col("_time") + F.expr("INTERVAL 1 HOUR")).alias("until_time"))
    s = s.withColumns({"use_for_sequence_eval": F.col("event_id") % 5 < 3, "seen_patient": F.col("event_id") % 2 == 0, "coverage_status": F.lit("valid")})
    return selection.select_segments(s, s.where("event_id % 4 = 0"), scope="same").select("event_id", "reference")


@query("p12_import_template", f"WITH {LB} SELECT label_id, start_ AS start, stop_ AS stop, CASE WHEN label_id % 6 = 0 THEN NULL ELSE label END AS label, label_id % 6 > 0 AND label_id % 5 > 0 AS valid FROM (SELECT *, date_trunc('second', start) AS start_, CASE WHEN label_id % 5 = 0 THEN date_trunc('second', start) ELSE date_trunc('second', stop) END AS stop_ FROM lb)")
def p12(spark, sf_dir):
    form = "yyyy-MM-dd HH:mm:ss"
    odd = F.col("label_id") % 2 == 1
    l = labels(spark, sf_dir).withColumn("stop", F.when(F.col("label_id") % 5 == 0, F.col("start")).otherwise(F.col("stop")))  # noqa: E741
    made = {}
    for which, c in (("from", "start"), ("until", "stop")):
        made[f"label_{which}_utc"] = F.when(odd, F.date_format(c, form)).otherwise("  ")
        made[f"label_{which}_local"] = F.when(~odd, F.date_format(times.to_local(F.col(c), "Asia/Tokyo"), form))
    made["mov_type"] = F.when(F.col("label_id") % 6 == 0, "").otherwise(F.col("label"))
    return autolabel.import_template(l.withColumns(made).drop("start", "stop", "label"), zone="Asia/Tokyo").select("label_id", "start", "stop", "label", "valid")


@query("p13_labelling_template", f"WITH {LB} SELECT label_id, reference, '' AS mov_type, '' AS label_quality, '' AS review_notes FROM lb")
def p13(spark, sf_dir):
    return autolabel.labelling_template(labels(spark, sf_dir).select("label_id", "reference"))


@query("p15_threshold", "SELECT event_id, CAST(least(value / 200, 1.0) >= 0.1 AS INTEGER) AS prediction, CASE WHEN least(value / 200, 1.0) >= 0.1 THEN 'walking' ELSE 'not_walking' END AS prediction_label FROM events")
def p15(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("event_id", lab.predicted(F.col("probability"), 0.1).alias("prediction"))
    return rows.withColumn("prediction_label", lab.label_of(F.col("prediction")))


@query("p16_block_ids", r"SELECT o_orderkey, trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '_') || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_' || strftime(o_orderdate + INTERVAL 10 MINUTE, '%Y%m%dT%H%M%S') AS block_id FROM orders")
def p16(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.block_id(F.col("o_orderpriority"), d, d + F.expr("INTERVAL 10 MINUTES")).alias("block_id"))


@query("p18_window_roles", f"WITH {LB}, d AS (SELECT label_id, label, 500 + label_id % 300 AS duration_s FROM lb) SELECT label_id, NOT (label = 'not_walking' AND duration_s > 600) AS use_for_main_dataset, TRUE AS use_for_sequence_eval, CASE WHEN label = 'not_walking' AND duration_s > 600 THEN 'long_negative' ELSE '' END AS drop_reason FROM d")
def p18(spark, sf_dir):
    rows = labels(spark, sf_dir).select("label_id", "label", (500 + F.col("label_id") % 300).alias("duration_s"))
    return selection.assign_roles(rows).drop("label", "duration_s")


@query("p19_valid_manifest", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def p19(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "valid_both_feet").otherwise("no_records").alias("audit_status"))
    return selection.valid_manifest(o).select("o_orderkey")


_LABEL_TEXTS = """lt AS (SELECT label_id, 'R' || reference AS reference, start, stop, CASE label_id % 4 WHEN 0 THEN ' walking' WHEN 1 THEN 'not_walking  ' WHEN 2 THEN label ELSE 'running' END AS mov_type FROM lb)"""


def _label_texts(spark, sf_dir):
    """A label table as people fill it in: texts of mixed forms, blanks, unknown labels."""
    k = F.col("label_id") % 4
    form = lambda c: F.when(k == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    mov = F.when(k == 0, " walking").when(k == 1, "not_walking  ").when(k == 2, F.col("label")).otherwise("running")
    return labels(spark, sf_dir).select("label_id", F.concat(F.lit("R"), F.col("reference").cast("string")).alias("reference"), form("start").alias("datefrom"), form("stop").alias("dateuntil"), mov.alias("mov_type"))


@query("p20_load_labels", f"WITH {LB}, {_LABEL_TEXTS} SELECT reference, date_trunc('second', start) AS start, date_trunc('second', stop) AS stop, trim(mov_type) AS label FROM lt WHERE trim(mov_type) IN ('walking', 'not_walking')")
def p20(spark, sf_dir):
    return points.load_labels(_label_texts(spark, sf_dir))


@query("s6_read_csv", f"WITH {LB}, {_LABEL_TEXTS} SELECT reference, date_trunc('second', start) AS start, date_trunc('second', stop) AS stop, trim(mov_type) AS label, label_id % 2 AS part FROM lt WHERE trim(mov_type) IN ('walking', 'not_walking')")
def s6(spark, sf_dir):
    """Label tables written as CSV, two folders, and read back together with the folder of each row."""
    path = sinks.scratch_path(spark, "labels")
    rows = _label_texts(spark, sf_dir)
    for part in (0, 1):
        sinks.save(rows.where(F.col("label_id") % 2 == part).drop("label_id"), f"{path}/part{part}.csv")
    files = session(spark).read.csv([f"{path}/part{p}.csv" for p in (0, 1)], header=True, schema="reference string, datefrom string, dateuntil string, mov_type string")
    found = points.load_labels(files.select("*", F.col("_metadata.file_path").alias("source_file")))
    return found.withColumn("part", F.regexp_extract("source_file", r"part([0-9])\.csv", 1).cast("long")).drop("source_file")


@query("s10_append_chunks", f"WITH {_PT} SELECT reference, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS checksum FROM pt GROUP BY 1")
def s10(spark, sf_dir):
    """Chunks appended one after the other, two of them twice; every row is there once."""
    path, rows = sinks.scratch_path(spark, "chunks"), _points(spark, sf_dir)
    for part in (0, 1, 2, 1, 0):
        sinks.append_chunk(rows.where(F.pmod("reference", F.lit(3)) == part), path, f"part-{part}")
    return sinks.read_chunks(session(spark), path, rows.schema).groupBy("reference").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("checksum"))


@query("s11_save_by_extension", "SELECT form, o_orderkey, o_totalprice FROM orders, (SELECT unnest(['csv', 'parquet']) AS form)", "o_totalprice")
def s11(spark, sf_dir):
    path, rows = sinks.scratch_path(spark, "saved"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    for form in ("csv", "parquet"):
        sinks.save(rows, f"{path}/x.{form}")
    back = {"csv": points.read_csv(session(spark), f"{path}/x.csv", "o_orderkey long, o_totalprice double"), "parquet": points.read_parquet(session(spark), f"{path}/x.parquet")}
    return reshape.union_reports(back).withColumnRenamed("report", "form")


@query("s12_save_each", f"WITH {LB} SELECT reference, label_id, label FROM lb")
def s12(spark, sf_dir):
    path = sinks.scratch_path(spark, "each")
    sinks.save_each(labels(spark, sf_dir).select("reference", "label_id", "label"), path)
    return session(spark).read.option("basePath", path).csv(path, header=True, schema="label_id long, label string, reference long")


@query("s15_audit_statuses", f"WITH {EV} SELECT 'ok' AS status, count(*) FILTER (event_type <> 'view') AS n_rows FROM ev WHERE foot IS NOT NULL UNION ALL SELECT 'partial', count(*) FROM ev WHERE foot IS NOT NULL")
def s15(spark, sf_dir):
    """Two audit records, written and read back: row totals from counters, or from the feet where there are none."""
    path, rows = sinks.scratch_path(spark, "audits"), events(spark, sf_dir).where("foot is not null")
    sinks.save_audit(rows.where("event_type <> 'view'"), path)
    sinks.audit_record(rows, "partial").drop("counters").write.mode("append").json(path)
    return points.audit_statuses(session(spark), path).drop("file")


@query("p14_feature_columns", "SELECT unnest(['c_acctbal', 'c_nationkey']) AS name, count(*) AS n_rows, avg(c_acctbal) AS mean FROM customer", "mean")
def p14(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    names = contracts.numeric_features(c, ["c_custkey"])
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("c_acctbal").alias("mean")).select(F.explode(F.array(*(F.lit(n) for n in sorted(names)))).alias("name"), "n_rows", "mean")


@query("t4_sorted_output", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def t4(spark, sf_dir):
    """Files in one order, read back with the place that each row has in it: rows before its file, and in it."""
    path = sinks.scratch_path(spark, "sorted")
    sinks.save_sorted(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), path, ["o_orderdate", "o_orderkey"])
    back = session(spark).read.parquet(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"part-([0-9]+)", 1).cast("int"))
    inside = Window.partitionBy("file").orderBy(F.col("_metadata.row_index"))
    rows = back.withColumn("n", F.row_number().over(inside))
    before = rows.groupBy("file").agg(F.max("n").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("file", "before"), "file").select("o_orderkey", (F.col("before") + F.col("n") - 1).alias("place"))

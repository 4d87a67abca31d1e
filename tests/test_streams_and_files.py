"""Streams against their batch forms, and files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from motionlake.operators import autolabel, segments
from motionlake.sources import points, sinks
from motionlake.streaming import live, replay

T0 = datetime(2024, 1, 1)
SCHEMA = "reference string, foot string, _time timestamp, value double, probability double"


@pytest.fixture
def folder(spark, tmp_path):
    data = [(f"r{i % 2}", "Left", T0 + timedelta(seconds=i), float((i * 37) % 11), ((i * 29) % 17) / 17) for i in range(200)]
    for part in range(4):
        spark.createDataFrame(data[part * 50 : part * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_energy_is_the_batch_energy(spark, folder):
    got = run(live.motion_energy(source(spark, folder), by=["reference", "foot"], value="value", window="10 seconds", late="60 seconds"), "energy")
    want = {(r.reference, r.window_start): round(r.energy, 9) for r in autolabel.motion_energy(spark.read.parquet(folder), by=["reference", "foot"], value="value", window_us=10_000_000).collect()}
    rows = got.collect()
    assert rows and all(want[r.reference, r.window_start] == round(r.energy, 9) for r in rows)


def test_streamed_hysteresis_is_the_batch_hysteresis(spark, folder):
    got = {(r.reference, r._time): r.state for r in run(live.live_hysteresis(source(spark, folder), key="reference", time="_time", hi=0.5, lo=0.4, k=2, m=3), "states").collect()}
    batch = segments.hysteresis(spark.read.parquet(folder), "probability", hi=0.5, lo=0.4, k=2, m=3, by=["reference"], order=["_time"])
    want = {(r.reference, r._time): r.state for r in batch.collect()}
    assert len(got) >= len(want) - 2 * 3 and all(want[k] == v for k, v in got.items())


def test_sessions_and_dedup(spark, folder):
    twice = source(spark, folder)
    n = run(live.dedup_samples(twice.unionByName(twice), ["reference", "_time"]), "once").count()
    assert n == 200
    s = run(live.activity_sessions(source(spark, folder), by=["reference"], gap="2 seconds", late="10 seconds"), "sessions")
    assert s.count() <= 2


def test_bundle_round_trip(spark, tmp_path):
    text = "﻿Time,Ax channel 1\r\n2024-01-01 00:00:00,1.5\r\n2024-01-01 00:00:00,bad\r\n\r\n"
    (tmp_path / "left_one.csv").write_text(text, encoding="utf-8")
    (tmp_path / "Right_two.csv").write_text(text.replace("Ax", "Gy"), encoding="utf-8")
    got = sorted((r.foot, r.signal, r.sample_order, r.value) for r in points.import_bundle(spark, str(tmp_path), reference="P001").collect())
    assert got == [("Left", "Ax", 0, 1.5), ("Left", "Ax", 1, None), ("Right", "Gy", 0, 1.5), ("Right", "Gy", 1, None)]


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", "Left", T0, 1.0), ("b", "Right", T0, 2.0)], "reference string, foot string, _time timestamp, v double")
    out = str(tmp_path / "table")
    sinks.append(df, out)
    sinks.replace(df.where("reference = 'b'").withColumn("v", F.lit(9.0)), out)
    assert sorted((r.reference, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 9.0)]
    sinks.save(df, f"{tmp_path}/x.csv")
    assert points.read_csv(spark, f"{tmp_path}/x.csv", "reference string, foot string, _time timestamp, v double").count() == 2
    with pytest.raises(ValueError):
        sinks.save(df, f"{tmp_path}/x.txt")
    sinks.save_each(df, f"{tmp_path}/each")
    sinks.save_sorted(df, f"{tmp_path}/sorted", ["reference"])
    sinks.save_audit(df, f"{tmp_path}/audit")
    assert [(r.status, r.n_rows) for r in points.audit_statuses(spark, f"{tmp_path}/audit").collect()] == [("ok", 2)]
    assert points.pending(df, df.where("reference = 'a'"), ["reference"]).count() == 1


def test_registered_streams_keep_every_row(spark, tmp_path):
    """Ten files, the latest events first: windows, sessions and states equal those of the batch operators."""
    from motionlake.plans import common, registry

    data = [(i, i % 5, ("view", "click")[i // 5 % 2], T0 + timedelta(hours=3 * (i // 10) + i % 3), float((i * 37) % 43)) for i in range(1000)]
    for part in range(9, -1, -1):
        spark.createDataFrame(data[part * 100 : part * 100 + 100], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    sf_dir = str(tmp_path)
    e = common.events(spark, sf_dir).drop("foot").withColumnRenamed("event_type", "foot").withColumn("reference", F.col("reference").cast("string")).cache()

    def rows(df):
        times = [F.col(f.name).cast("timestamp_ntz") if f.dataType.typeName() == "timestamp" else F.round(f.name, 6) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields]
        return sorted(map(tuple, df.select(*times).collect()), key=str)

    energy = autolabel.motion_energy(e, by=["reference", "foot"], value="value", window_us=86_400_000_000)
    assert rows(registry.QUERIES["x2_stream_energy"](spark, sf_dir)) == rows(energy.select("reference", "foot", "window_start", "energy", "samples"))

    statistics = [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")]
    day = F.date_trunc("day", "_time")
    both = e.withColumn("window_start", F.explode(F.array(day, day - F.expr("INTERVAL 1 DAY"))))
    assert rows(registry.QUERIES["x3_stream_sliding"](spark, sf_dir)) == rows(both.groupBy("foot", "window_start").agg(*statistics))

    parted = segments.gap_segments(e, by=["reference"], time="_time", gap_us=12 * 3_600_000_000, tie=["event_id"])
    sessions = parted.groupBy("reference", "segment").agg(F.min("_time").alias("first"), F.max("_time").alias("last"), F.count(F.lit(1)).alias("n")).drop("segment")
    assert rows(registry.QUERIES["x4_stream_sessions"](spark, sf_dir)) == rows(sessions)

    p = e.withColumn("probability", F.least(F.col("value") / 200, F.lit(1.0)))
    states = segments.hysteresis(p, "probability", hi=0.1, lo=0.05, k=2, m=2, by=["reference"], order=["_time", "event_id"])
    assert rows(registry.QUERIES["x6_stream_hysteresis"](spark, sf_dir)) == rows(states.select("reference", "_time", "probability", "state"))

    counts = sorted(map(tuple, e.groupBy("reference", "foot").agg(F.countDistinct("_time").alias("n")).collect()))
    assert sorted(map(tuple, registry.QUERIES["x1_stream_dedup"](spark, sf_dir).select("reference", "foot", "n_rows").collect())) == counts
    assert sorted(map(tuple, registry.QUERIES["x7_stream_coverage"](spark, sf_dir).select("reference", "foot", "n_rows").collect())) == sorted(map(tuple, e.groupBy("reference", "foot").count().collect()))


def test_state_of_a_replay_is_bounded_by_open_windows(spark, tmp_path):
    """200 windows of shuffled rows in eight slices: no more are held than one slice makes, and none is lost or doubled."""
    data = [(f"r{i % 2}", "Left", T0 + timedelta(seconds=(i * 7919) % 1000), float(i % 13), 0.0) for i in range(3000)]
    rows = spark.createDataFrame(data, SCHEMA)
    closing = rows.limit(1).withColumn("_time", F.lit(T0 + timedelta(hours=1)))

    def make(stream):
        return live.motion_energy(stream, by=["reference"], value="value", window="10 seconds", late=replay.NO_DELAY)

    got, held = replay.in_time_order(rows, make, str(tmp_path / "eight"), slices=8, closing=closing)
    want = autolabel.motion_energy(rows, by=["reference"], value="value", window_us=10_000_000)
    keys = ["reference", "window_start", F.round("energy", 6), "samples"]
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect())) and got.count() == 200
    assert len(held) == 9 and max(held) <= 2 * (1000 // 8 // 10 + 3) and held[-1] == 1
    whole, held = replay.in_time_order(rows, make, str(tmp_path / "one"), slices=1, closing=closing)
    assert whole.count() == 200 and len(held) == 2


def test_replay_of_ties_missing_times_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Left", T0, 1.0, 0.0)] * 50 + [("a", "Left", None, 2.0, 0.0), (None, None, T0, None, None)], SCHEMA)
    got, held = replay.in_time_order(rows, lambda stream: stream, str(tmp_path / "ties"), slices=4)
    assert got.count() == 52 and got.columns == rows.columns and held == [0] * len(held)
    got, held = replay.in_time_order(rows.limit(0), lambda stream: stream, str(tmp_path / "none"), slices=4)
    assert got.count() == 0 and got.columns == rows.columns and held == []
    with pytest.raises(ValueError):
        replay.in_time_order(rows, lambda stream: stream, str(tmp_path / "many"), slices=257)

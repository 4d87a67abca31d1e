"""What the third round's findings asked for."""

import glob
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from motionlake.operators import autolabel, coverage, ferns, selection
from motionlake.sources import sinks
from motionlake.streaming import live

T0 = datetime(2024, 1, 1)


def test_a_reference_is_one_file_however_many_tasks_hold_it(spark, tmp_path):
    df = spark.range(0, 80, 1, 4).select((F.col("id") % 5).alias("reference"), "id").unionByName(spark.createDataFrame([(None, 100)], "reference long, id long"))
    sinks.save_each(df, f"{tmp_path}/each")
    assert sorted(len(glob.glob(f"{x}/*.csv")) for x in glob.glob(f"{tmp_path}/each/reference=*")) == [1] * 6
    got = spark.read.csv(f"{tmp_path}/each", header=True, schema="id long, reference long")
    assert sorted(map(tuple, got.select("id", "reference").collect())) == sorted(map(tuple, df.select("id", "reference").collect()))
    sinks.save_each(df, f"{tmp_path}/large", rows=4)
    assert len(glob.glob(f"{tmp_path}/large/reference=1/*.csv")) > 1
    assert spark.read.csv(f"{tmp_path}/large", header=True).count() == 81


def test_votes_stand_once_for_equal_rows_of_a_block_and_equal_those_of_leaves(spark):
    rows = [(i, f"r{i % 3}", i % 7 // 3, [i % 7 // 3, 9] if i % 5 == 0 else [i % 7 // 3], i % 2, [(i * i) % 10, i % 4]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, reference string, block int, held array<int>, target int, cell array<int>")
    asked = ferns.questions(2, trees=5, depth=3)
    how = {"by": "reference", "block": "block", "target": "target", "held": "held", "models": []}
    votes = ferns.block_votes(df, pattern="cell", asked=asked, **how).collect()
    assert len(votes) == len({(r[1], r[2], tuple(r[5])) for r in rows}) and sum(v.n for v in votes) == 3000
    found = ferns.leave_block_out(df.withColumn("leaves", ferns.leaves_of(F.col("cell"), asked)), by="reference").collect()
    got = {(r.reference, r.block, tuple(r.cell)): r.walking_probability for r in found}
    assert got == {(v.reference, v.block, tuple(v.cell)): v.walking_probability for v in votes} and len(found) == 3000


def test_scores_that_differ_by_the_order_of_a_sum_fall_on_one_side(spark):
    a, b = 0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1
    assert a != b
    df = spark.createDataFrame([(b, 0.1, a), (a, b, 9.0), (0.5, 0.1, 0.9)], "score double, low double, high double")
    got = df.select(autolabel.window_class(F.col("score"), F.col("low"), F.col("high"), True).alias("label")).collect()
    assert [r.label for r in got] == ["walking", "not_walking", "ambiguous"]


def test_more_common_hours_come_first_however_little_more(spark):
    rows = [(r, foot, t) for r, us in (("a", 0), ("b", 900)) for foot in ("Left", "Right") for t in (T0, T0 + timedelta(hours=3, microseconds=us))]
    found = coverage.inventory(spark.createDataFrame(rows, "reference string, foot string, _time timestamp")).withColumn("reference_class", F.lit("x"))
    assert [r.reference for r in selection.priority_order(found).collect()] == ["b", "a"]


def test_a_sequence_costs_two_round_trips_for_state_in_a_batch():
    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def exists(self):
            calls.append("exists")
            return self.kept is not None

        def update(self, x):
            calls.append("update")
            self.kept = x

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

    m = live._Hysteresis(0.5, 0.2, 2, 2, "reference", "at")
    m.init(Handle())
    batch = lambda p, at, ends: pd.DataFrame({"at": pd.date_range(T0 + timedelta(seconds=at), periods=len(p), freq="s"), "probability": p, "ends": ends})
    first = pd.concat(m.handleInputRows(("r",), iter([batch([0.1, 0.9], 0, False)]), None))
    second = pd.concat(m.handleInputRows(("r",), iter([batch([0.9, 0.1], 2, False), batch([0.0], 9, True)]), None))
    assert len(calls) == 4
    assert [*first["state"], *second["state"]] == [0, 1, 1, 1] and list(second["at"])[0] == T0 + timedelta(seconds=1)

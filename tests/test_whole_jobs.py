"""Registered queries cover the whole of their tables."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from definitions import dropped_by_definition, states_by_definition

from motionlake.operators import intervals, segments
from motionlake.plans import common, registry

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@given
@pytest.mark.parametrize("name", ["m8_boosted_trees", "m10_sequence_classifier", "m18_class_weight_sweep"])
def test_every_fold_is_judged(spark, name):
    if name == "m10_sequence_classifier":
        p = common.predictions(spark, DATA)
        n = segments.context_sequences(p, by=["reference"], order="_time", features=["probability"], length=5, tie=["event_id"]).count()
    else:
        n = common.table(spark, DATA, "embeddings").count()
    got = registry.QUERIES[name](spark, DATA)
    if "fold" in got.columns:
        assert sorted(r.fold for r in got.select("fold").collect()) == [0, 1, 2]
        assert got.agg(F.sum("n_rows")).collect()[0][0] == n
    else:
        assert {r.tp + r.fp + r.fn + r.tn for r in got.collect()} == {n} and got.count() == 4


def test_embargo_of_folds_with_many_references(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = spark.createDataFrame([(i, r, at(s - 1), at(s + 1)) for i, (r, s) in enumerate([("a", 0), ("a", 30), ("a", 100), ("b", 0), ("b", 100), ("c", 0)])], "id long, reference string, seq_start timestamp, seq_stop timestamp")
    folds = spark.createDataFrame([(0, "a", at(0), at(20)), (0, "b", at(90), at(95)), (1, "c", at(0), at(5))], "fold int, reference string, start timestamp, stop timestamp")
    got = sorted((r.fold, r.id) for r in intervals.sequence_embargo(rows, folds, seconds=15).collect())
    assert got == [(0, 2), (0, 3), (0, 5), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_hysteresis_is_native_and_equals_the_machine(spark):
    import random

    rng = random.Random(4)
    data = [(r, i, rng.choice([None, float("nan"), 0.1, 0.3, 0.35, 0.5, 0.6, 0.9])) for r in ("a", "b", "c") for i in range(300)]
    df = spark.createDataFrame(data, "reference string, i long, p double").repartition(5)
    for hi, lo, k, m in [(0.5, 0.3, 2, 3), (0.5, 0.5, 1, 1), (0.6, 0.2, 3, 1), (0.3, 0.3, 1, 4), (0.3, 0.6, 2, 2), (0.3, 0.6, 1, 1), (0.35, 0.9, 3, 2), (0.3, 0.6, 1, 4)]:
        out = segments.hysteresis(df, "p", hi=hi, lo=lo, k=k, m=m, by=["reference"], order=["i"], block=37)
        got = {(r.reference, r.i): r.state for r in out.collect()}
        for ref in "abc":
            p = [0.0 if v is None or v != v else v for r, _, v in data if r == ref]
            assert [got[ref, i] for i in range(300)] == states_by_definition(p, hi, lo, k, m), (hi, lo, k, m)
        assert "Pandas" not in out._jdf.queryExecution().toString()


def test_conflicts_are_resolved_chain_by_chain(spark):
    import random

    rng = random.Random(5)
    data = [(f"r{i % 3}", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + rng.randrange(1, 9)), rng.choice(["walking", "not_walking"])) for i, s in enumerate(rng.sample(range(2000), 300))]
    out = intervals.resolve_conflicts(spark.createDataFrame(data, "reference string, start timestamp, stop timestamp, label string"))
    want = {}
    for ref in {x[0] for x in data}:
        own = sorted(x for x in data if x[0] == ref)
        want |= dict(zip(own, dropped_by_definition([x[1:] for x in own]), strict=True))
    assert {(r.reference, r.start, r.stop, r.label): r.dropped for r in out.collect()} == want and any(want.values())

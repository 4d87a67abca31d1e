"""Fold plans, exact percentiles, nearest rows over buckets, and tables of chunks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import folds, intervals, metrics, models
from motionlake.sources import sinks

T0 = datetime(2024, 1, 1)


def test_group_plan_has_the_score_that_it_tells(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", rng.choice([0, 1]), rng.choice("xy")) for g in range(14) for _ in range(rng.randrange(1, 30))]
    rows += [(f"twin{i}", y, "x") for i in range(9) for y in (0, 1, 1)] + [(None, 1, "x")]  # groups of equal counts
    df = spark.createDataFrame(rows, "g string, y int, s string")
    plan = folds.group_folds(df, group="g", target="y", source="s", k=3, restarts=40, seed=2)
    got = plan.collect()
    assert sorted(r.g for r in got) == sorted({r[0] for r in rows if r[0]}) and {r.fold for r in got} == {0, 1, 2}
    told = {r.plan_score for r in got}
    assert len(told) == 1
    named = df.where("g is not null")
    score = lambda p: folds.plan_score(named, p, group="g", target="y", source="s", k=3).first()[0]
    assert score(plan) == pytest.approx(told.pop())
    turn = spark.createDataFrame([(g, i % 3) for i, g in enumerate(sorted({r[0] for r in rows if r[0]}))], "g string, fold int")
    assert score(plan) < score(turn)
    assert {(r.g, r.fold) for r in folds.group_folds(df.repartition(7), group="g", target="y", source="s", k=3, restarts=40, seed=2).collect()} == {(r.g, r.fold) for r in got}
    assert {r.fold for r in folds.group_folds(df, group="g", target="y", source=None, k=5, restarts=1).collect()} == set(range(5))


def test_plan_score_by_hand(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0)], "g string, y int")
    plan = spark.createDataFrame([("a", 0), ("b", 1)], "g string, fold int")
    # rows 2 and 2: even; class 0: 1 and 2 of 1.5; class 1: 1 and 0 of 0.5; classes weigh twice
    want = 2 * 2 * (0.5 / 1.5) ** 2 + 2 * 2 * 1.0
    assert folds.plan_score(df, plan, group="g", target="y", source=None, k=2).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_percentiles_are_exact(spark, bins):
    rng = np.random.default_rng(3)
    groups = {"even": rng.integers(0, 6, 500).astype(float), "wide": np.r_[rng.normal(0, 1, 300), 1e12, -1e12], "one": np.array([4.0]), "same": np.full(50, 7.0), None: rng.exponential(1, 77)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: [r[c] for c in shares] for r in metrics.percentiles(df, "v", shares, by=["k"], bins=bins).collect()}
    assert got.pop("none") == [None] * 5
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k] == pytest.approx(np.quantile(x, list(shares.values())).tolist()), k
    whole = metrics.percentiles(df, "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))))


@pytest.mark.parametrize("width", [1_000_000, 60_000_000, 10**15])
def test_nearest_rows_over_buckets(spark, width):
    rng = random.Random(4)
    left = [(i, rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(400))) for i in range(120)] + [(900, "a", None), (901, None, T0)]
    right = [(1000 + i, rng.choice("ab"), T0 + timedelta(seconds=rng.randrange(400))) for i in range(60)]
    got = {r.id: (r.right_time, r.right_rid) for r in intervals.asof_nearest(
        spark.createDataFrame(left, "id long, reference string, t timestamp"), spark.createDataFrame(right, "rid long, reference string, t timestamp"),
        on="t", key="id", tolerance_us=9_000_000, right_columns=["rid"], tie="rid", bucket_us=width).collect()}
    want = {}
    for i, ref, t in left:
        near = [(abs(t - u), u > t, -rid, u) for rid, other, u in right if t and other == ref and abs(t - u) <= timedelta(seconds=9)]
        if near:
            _, _, rid, u = min(near)
            want[i] = (u, -rid)
    assert got == want


def test_chunks_can_be_repeated_and_killed(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.range(90).withColumn("part", (F.col("id") % 3).cast("int"))
    ids = lambda: sorted(r.id for r in sinks.read_chunks(spark, path, rows.schema).collect())
    assert ids() == []
    for part in (0, 1, 1, 0):
        sinks.append_chunk(rows.where(F.col("part") == part), path, f"c{part}")
    assert ids() == [i for i in range(90) if i % 3 < 2]
    broken = rows.where("part = 2").withColumn("id", F.when(F.col("id") > 80, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        sinks.append_chunk(broken, path, "c2")
    assert ids() == [i for i in range(90) if i % 3 < 2]  # half of it is there, and nobody reads it
    sinks.append_chunk(rows.where("part = 2"), path, "c2")
    sinks.append_chunk(rows.where("part = 5"), path, "empty")
    assert ids() == list(range(90)) and set(sinks.committed_chunks(spark, path)) == {"c0", "c1", "c2", "empty"}
    assert sinks.remove_uncommitted(spark, path) >= 2 and ids() == list(range(90))
    other = rows.where("part = 1").withColumn("id", F.col("id") + 1000)
    sinks.append_chunk(other, path, "c1")
    assert len(ids()) == 90 and max(ids()) == 1088


def test_logistic_fit_is_at_its_optimum(spark):
    """Without a penalty the best fit has no gradient: residuals are orthogonal to every feature and sum to zero."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3)) * [1, 10, 0.1]
    y = (x @ [1.0, -0.1, 4.0] + rng.logistic(0, 1, 400) > 0.3).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    out = models.score(df, models.logistic(["a", "b", "c"], "y").fit(df)).toPandas()
    rest = out["walking_probability"] - out["y"]
    assert abs(rest.sum()) < 0.05 and all(abs((rest * out[c] / out[c].std()).sum()) < 0.05 for c in "abc")


def test_out_of_fold_predictions_cover_every_row_once(spark):
    df = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("a"))
    out = models.out_of_fold(df, models.logistic(["a"], "y"), [0, 1, 2]).collect()
    assert sorted(r.id for r in out) == list(range(90))
    alone = models.score(df.where("fold = 1"), models.logistic(["a"], "y").fit(df.where("fold <> 1")))
    assert {r.id: r.walking_probability for r in alone.collect()} == {r.id: pytest.approx(r.walking_probability) for r in out if r.fold == 1}

"""Masks of held-out blocks, and the ensemble that leaves one block out, against plain Python."""

import random
from datetime import datetime, timedelta

from motionlake.operators import ferns, folds, models

T0 = datetime(2024, 1, 1)


def table(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows, at = [], {"a": T0, "b": T0, None: T0}
    for i in range(n):
        ref = rng.choice(["a", "b", None])
        at[ref] += timedelta(seconds=rng.choice([1, 1, 2, 9, 30]))
        rows.append((i, ref, at[ref], int((at[ref] - T0).total_seconds()) // 40, rng.randrange(2), rng.gauss(0, 1), rng.gauss(2, 3)))
    return rows, spark.createDataFrame(rows, "id int, reference string, _time timestamp, block int, target int, x double, y double")


def plain_masks(rows, seconds):
    span = {}
    for r in rows:
        low, high = span.get(r[1:4:2], (r[2], r[2]))
        span[r[1:4:2]] = (min(low, r[2]), max(high, r[2]))
    e = timedelta(seconds=seconds)
    return {r[0]: sorted(b for (ref, b), (low, high) in span.items() if ref == r[1] and low - e <= r[2] <= high + e) for r in rows}


def test_masks_hold_out_the_own_block_and_the_embargo(spark):
    rows, df = table(spark)
    for width in (7_000_000, folds.intervals.DAY_US):
        got = {r.id: r.held for r in folds.held_out(df, by="reference", block="block", seconds=15, width_us=width).collect()}
        assert got == plain_masks(rows, 15)
    assert folds.held_out(df.where("id < 0"), by="reference", block="block", seconds=15).count() == 0


def test_a_row_without_time_is_held_out_by_its_own_block(spark):
    df = spark.createDataFrame([("a", None, 7), ("a", T0, 8)], "reference string, _time timestamp, block int")
    assert sorted(r.held for r in folds.held_out(df, by="reference", block="block", seconds=5).collect()) == [[7], [8]]


def test_training_sizes_and_rows_follow_the_masks(spark):
    rows, df = table(spark)
    masks = plain_masks(rows, 15)
    masked = folds.held_out(df, by="reference", block="block", seconds=15)
    got = {(r.reference, r.block): (r.n_test, r.n_train, r.n_train_1) for r in folds.training_sizes(masked, by="reference", block="block", target="target").collect()}
    want = {}
    for ref, b in {(r[1], r[3]) for r in rows}:
        left = [r for r in rows if not (r[1] == ref and b in masks[r[0]])]
        want[ref, b] = (sum(r[1] == ref and r[3] == b for r in rows), len(left), sum(r[4] for r in left))
    assert got == want
    kept = {r.id for r in folds.training_rows(masked, 2).collect()}
    assert kept == {i for i, held in masks.items() if 2 not in held}


def test_masked_fits_don_t_see_what_they_hold_out(spark):
    """Labels flip inside the embargo of fold 1: a fit that saw those rows would be misled."""
    rows = [(i, 0 if i < 40 else 1, float(i % 2), i % 2, [0]) for i in range(40)] + [(100 + i, 1, float(i % 2), i % 2, [1]) for i in range(10)] + [(200 + i, 0, float(i % 2), 1 - i % 2, [0, 1]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, fold int, x double, y int, held array<int>")
    out = models.out_of_fold(df, models.logistic(["x"], "y", rounds=5), [1], held="held").collect()
    assert len(out) == 10 and all(r.prediction == r.y for r in out)


def plain_votes(rows, masks, asked):
    mean = lambda v: sum(v) / len(v)
    m = [mean([r[i] for r in rows]) for i in (5, 6)]
    s = [mean([(r[i] - m[i - 5]) ** 2 for r in rows]) ** 0.5 for i in (5, 6)]
    leaf = {r[0]: [int("".join(str(int(r[5 + f] > m[f] + z * s[f])) for f, z in q), 2) for q in asked] for r in rows}
    out = {}
    for r in rows:
        votes = 0
        for t in range(len(asked)):
            same = [o[4] for o in rows if leaf[o[0]][t] == leaf[r[0]][t] and not (o[1] == r[1] and r[3] in masks[o[0]])]
            votes += 1_000_000 * (sum(same) + 1) // (len(same) + 2)
        out[r[0]] = votes / (len(asked) * 1_000_000)
    return out


def test_leave_block_out_equals_counting_without_the_block(spark):
    rows, df = table(spark)
    asked = ferns.questions(2, trees=6, depth=3)
    masked = folds.held_out(ferns.leaves(df, ["x", "y"], asked), by="reference", block="block", seconds=15).fillna({"reference": "none"})
    got = {r.id: r.walking_probability for r in ferns.leave_block_out(masked, by="reference").collect()}
    assert got == plain_votes(rows, plain_masks(rows, 15), asked)


def test_rows_with_null_features_go_and_structure_is_fixed(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 5.0)], "id int, x double")
    assert sorted(r.id for r in ferns.leaves(df, ["x"], ferns.questions(1, 3, 2)).collect()) == [1, 4]
    assert ferns.questions(4, 5, 2, seed=1) == ferns.questions(4, 5, 2, seed=1) != ferns.questions(4, 5, 2, seed=2)

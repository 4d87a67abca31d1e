"""Fold plans that keep groups apart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times
from motionlake.operators import intervals


def stratified_folds(df: DataFrame, *, target: str, key: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """Folds 0..k-1 with even shares of each class. The order within a class is that of a hash of key and seed.

    Rows are ranked within (class, hash bucket) and buckets start where the ones before end, so that a class of any
    size is ranked by many tasks.
    """
    h = F.crc32(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumns({"_h": h, "_b": (h % 256).cast("int")})
    sizes = rows.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(target, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(target).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(target, "_b").orderBy("_h", key)) - 1
    return rows.join(before, [target, "_b"]).withColumn(out, ((F.col("_before") + rank) % k).cast("int")).drop("_h", "_b", "_before")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Each row once for each group, with is_test where the fold is its own group. The list of groups is one row; rows
    are repeated as they are read, without a join by rows."""
    listed = df.agg(F.array_sort(F.collect_set(F.struct(F.col(group).alias("g")))).alias("_groups"))
    each = df.crossJoin(F.broadcast(listed)).select(*df.columns, F.explode("_groups").alias("_g"))
    return each.select(*df.columns, F.col("_g.g").alias("fold_group")).withColumn("is_test", F.col(group).eqNullSafe(F.col("fold_group")))


def held_out(rows: DataFrame, *, by: str, block: str, time: str = "_time", seconds: float = 0.0, width_us: int = intervals.DAY_US, out: str = "held") -> DataFrame:
    """`out`: the blocks of the same `by` that must not learn from a row: its own and those that it is within `seconds` of.

    A mask in place of a plan: no row is repeated for the folds that may learn from it, and a fold's training rows are
    those whose mask lacks it (`training_rows`). The spans that touch a time bucket are one row, so rows are shuffled
    once, and a hot key is spread over its buckets. A row without a time is held out by its own block alone.
    """
    e = int(seconds * times.SECOND)
    us = times.micros(time)
    spans = rows.groupBy(by, block).agg((F.min(us) - e).alias("low"), (F.max(us) + e).alias("high")).where("low is not null")
    dealt = spans.withColumn("_of", F.explode(F.sequence(F.floor(F.col("low") / width_us), F.floor(F.col("high") / width_us))))
    near = dealt.groupBy(F.col(by).alias("_by"), "_of").agg(F.collect_list(F.struct("low", "high", F.col(block).alias("block"))).alias("_near"))
    timed = rows.withColumn("_bucket", F.floor(us / width_us))
    met = timed.join(near, timed[by].eqNullSafe(near["_by"]) & (timed["_bucket"] == near["_of"]), "left")
    around = F.transform(F.filter("_near", lambda x: (us >= x["low"]) & (us <= x["high"])), lambda x: x["block"])
    own = F.array(F.col(block))
    return met.select(*(F.col(c) for c in rows.columns), F.array_sort(F.array_union(own, F.coalesce(around, own))).alias(out))


def training_rows(df: DataFrame, fold: int, *, held: str = "held") -> DataFrame:
    """The rows that a fold may learn from: those whose mask lacks it."""
    return df.where(~F.array_contains(held, F.lit(fold)))


def training_sizes(df: DataFrame, *, by: str, block: str, held: str = "held", target: str | None = None) -> DataFrame:
    """by, block, n_test, n_train (and n_train_1, those of class 1): all rows less those that the block holds out."""
    ones = F.count_if(F.col(target) == 1) if target else F.lit(0)
    total = df.agg(F.count(F.lit(1)).alias("_n"), ones.alias("_ones"))
    mine = F.col("_own") == F.col(block)
    out = df.withColumn("_own", F.col(block)).withColumn(block, F.explode(held)).groupBy(by, block).agg(F.count_if(mine).alias("n_test"), F.count(F.lit(1)).alias("_out"), ones.alias("_ones_out"))
    made = [(F.col("_n") - F.col("_out")).alias("n_train")] + ([(F.col("_ones") - F.col("_ones_out")).alias("n_train_1")] if target else [])
    return out.crossJoin(F.broadcast(total)).select(by, block, "n_test", *made)  # one row


def group_profile(df: DataFrame, *, group: str, target: str, time: str | None = None) -> DataFrame:
    """Rows, class counts and span of each group."""
    span = [F.min(time).alias("first_time"), F.max(time).alias("last_time")] if time else []
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(target) == 0).alias("target_0"), F.count_if(F.col(target) == 1).alias("target_1"), *span)


#: How much an uneven count of classes, and of classes within sources, weighs against one of rows and
#: sources; and what an uneven number of groups costs while groups are placed.
CLASS_WEIGHT, GROUP_WEIGHT = 2.0, 0.05


def group_counts(df: DataFrame, *, group: str, target: str, source: str | None) -> DataFrame:
    """group, cell, weight, n: for each group its rows, rows of each class, of each source and of each class in a source."""
    kinds = [("rows", F.lit("rows"), 1.0), ("class", F.col(target).cast("string"), CLASS_WEIGHT)]
    if source:
        kinds += [("source", F.col(source).cast("string"), 1.0), ("both", F.concat_ws("|", F.col(source).cast("string"), F.col(target).cast("string")), CLASS_WEIGHT)]
    cells = df.groupBy(group, target, *([source] if source else [])).agg(F.count(F.lit(1)).alias("_rows"))
    each = cells.select(group, "_rows", F.inline(F.array(*(F.struct(F.concat_ws(":", F.lit(k), v).alias("cell"), F.lit(w).alias("weight")) for k, v, w in kinds))))
    return each.groupBy(group, "cell", "weight").agg(F.sum("_rows").alias("n"))


def plan_score(df: DataFrame, folds: DataFrame, *, group: str, target: str, source: str | None, k: int) -> DataFrame:
    """plan_score of a plan (group, fold), one row: over all cells and folds the squared share by which a fold misses an
    even count, weighted. Lower is better."""
    counts = group_counts(df, group=group, target=target, source=source)
    sums = counts.join(folds.select(group, "fold"), group).groupBy("cell", "weight", "fold").agg(F.sum("n").alias("n"))
    goals = sums.groupBy("cell", "weight").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    goal = F.col("total") / k
    # folds without rows of a cell miss all of it; the sum over k folds of (n - goal)^2 is squares - k * goal^2
    return goals.agg(F.sum(F.col("weight") * (F.col("squares") - k * goal * goal) / (goal * goal)).alias("plan_score"))


def group_folds(df: DataFrame, *, group: str, target: str, source: str | None, k: int, restarts: int = 500, seed: int = 0) -> DataFrame:
    """A fold for each group (null groups have none), and plan_score of the plan.

    Groups are placed one by one where the weighted squared deviation from even counts, with a penalty for uneven numbers
    of groups, grows least: at first the largest groups first, then in random orders; the plan with the best score stays.

    A group is known by its counts alone. Groups of equal counts are one row with a multiplicity, and how many of them go
    to which fold is what a restart decides; restarts run in parallel tasks. The names of groups never leave Spark: the
    plan of the counts is joined back, and a group takes its place among its equals by its name.
    """
    counts = group_counts(df.where(F.col(group).isNotNull()), group=group, target=target, source=source)
    shape = counts.groupBy(group).agg(F.to_json(F.array_sort(F.collect_list(F.struct("cell", "weight", "n")))).alias("_shape"))
    kinds = shape.groupBy("_shape").agg(F.count(F.lit(1)).alias("many"))
    listed = kinds.agg(F.array_sort(F.collect_list(F.struct("_shape", "many"))).alias("kinds"))  # a row of distinct counts

    def tables(shapes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = [{c["cell"]: (c["n"], c["weight"]) for c in json.loads(s["_shape"])} for s in shapes]
        cells = sorted({c for x in known for c in x})
        table = np.array([[x.get(c, (0, 0.0))[0] for c in cells] for x in known], float)
        weight = np.array([max(x[c][1] for x in known if c in x) for c in cells])
        return table, weight, np.array([s["many"] for s in shapes])

    def place(table: np.ndarray, weight: np.ndarray, many: np.ndarray, attempt: int) -> tuple[float, np.ndarray]:
        rng = np.random.default_rng([seed, attempt])
        each = np.repeat(np.arange(len(table)), many)
        order = rng.permutation(each) if attempt else each[np.argsort(-(table.sum(1)[each]), kind="stable")]
        goal = (table * many[:, None]).sum(0) / k
        scale = weight / np.where(goal > 0, goal, 1.0) ** 2
        sums, groups, dealt = np.zeros((k, table.shape[1])), np.zeros(k), np.zeros((len(table), k), np.int64)
        for kind in order.tolist():
            # how much more a fold costs with this group: (a + x)^2 - a^2 = x (2a + x)
            more = (scale * table[kind] * (2 * (sums - goal) + table[kind])).sum(1) + GROUP_WEIGHT * (2 * (groups - len(each) / k) + 1)
            f = int(more.argmin())
            sums[f] += table[kind]
            groups[f] += 1
            dealt[kind, f] += 1
        return float((scale * (sums - goal) ** 2).sum()), dealt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for attempt, shapes in zip(pdf["id"], pdf["kinds"], strict=True):
                score, dealt = place(*tables(list(shapes)), int(attempt))
                if best is None or score < best[0]:
                    best = (score, int(attempt), [s["_shape"] for s in shapes], dealt)
        if best:
            yield pd.DataFrame({"plan_score": best[0], "attempt": best[1], "_shape": best[2], "_dealt": list(best[3])})

    spark = df.sparkSession
    tries = spark.range(0, max(1, restarts), 1, min(32, max(1, restarts))).crossJoin(F.broadcast(listed)).mapInPandas(run, "plan_score double, attempt long, _shape string, _dealt array<long>")
    best = tries.groupBy("_shape").agg(F.min_by(F.struct("_dealt", "plan_score"), F.struct("plan_score", "attempt")).alias("_best"))
    place_of = F.row_number().over(Window.partitionBy("_shape").orderBy(group)) - 1
    upto = F.aggregate(F.col("_best._dealt"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("fold")), lambda a, n: F.struct((a["sum"] + n).alias("sum"), (a["fold"] + (F.col("_at") >= a["sum"] + n).cast("int")).alias("fold")))
    return shape.withColumn("_at", place_of).join(best, "_shape").select(group, upto["fold"].alias("fold"), F.col("_best.plan_score").alias("plan_score"))


def fold_summary(df: DataFrame, folds: DataFrame, *, group: str, target: str) -> DataFrame:
    """Rows, classes and groups of each fold."""
    return df.join(folds, group).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(target) == 0).alias("target_0"), F.count_if(F.col(target) == 1).alias("target_1"), F.countDistinct(group).alias("n_groups"))


def uncovered_groups(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    return df.select(group).distinct().join(folds.select(group).distinct(), group, "left_anti")


def rotating_validation(folds: DataFrame, *, group: str, fold: str = "fold") -> DataFrame:
    """For each fold (its test groups given) the inner validation group: the (fold - 1)-th of the others, in turn."""
    others = folds.select(fold).distinct().crossJoin(F.broadcast(folds.select(group).distinct())).join(folds, [fold, group], "left_anti")
    w = Window.partitionBy(fold)
    ranked = others.withColumns({"_r": F.row_number().over(w.orderBy(group)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return ranked.where((F.col(fold) - 1) % F.col("_n") == F.col("_r")).select(fold, F.col(group).alias("validation_group"))


def split_by_reference(df: DataFrame, references: DataFrame, by: str = "reference") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: validation holds the listed references."""
    listed = references.select(by).distinct()
    return df.join(listed, by, "left_anti"), df.join(listed, by, "left_semi")

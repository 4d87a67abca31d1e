"""Binary metrics, summaries, distributions and threshold sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times
from motionlake.operators.segments import BUCKET_US, hysteresis, keyed, time_bucket


def _over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def from_counts(counts: DataFrame) -> DataFrame:
    """Metrics of tp, fp, fn, tn; an empty group has null metrics, an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = _over(tp, tp + fp), _over(tp, tp + fn)
    f1 = _over(2 * tp, 2 * tp + fp + fn)
    f1_negative = _over(2 * tn, 2 * tn + fp + fn)
    made = {
        "accuracy": _over(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "f1_macro": (f1 + f1_negative) / 2,
        "false_positive_rate": _over(fp, fp + tn),
        "false_negative_rate": _over(fn, fn + tp),
        "specificity": _over(tn, tn + fp),
    }
    return counts.withColumns({name: F.when(n > 0, value) for name, value in made.items()})


def confusion(y: str, yhat: str) -> list[Column]:
    t, p = F.col(y), F.col(yhat)
    return [F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn")]


def binary_metrics(df: DataFrame, y: str, yhat: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Counts and metrics of each group in one pass."""
    return from_counts(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *confusion(y, yhat)))


def fold_means(folds: DataFrame, metrics: Sequence[str], *, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Mean and sample deviation of each metric over folds, and means weighted by test rows."""
    made = [F.count(F.lit(1)).alias("n_folds")]
    for m in metrics:
        made += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
        if weight:
            made.append((F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(f"{m}_weighted"))
    return folds.groupBy(*by).agg(*made)


def error_summary(df: DataFrame, y: str, yhat: str, by: str = "reference") -> DataFrame:
    """Errors of each reference, most false positives first."""
    found = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *confusion(y, yhat))
    return found.withColumns({"fp_rate": _over(F.col("fp"), F.col("fp") + F.col("tn")), "fn_rate": _over(F.col("fn"), F.col("fn") + F.col("tp"))}).orderBy(F.desc("fp"), F.desc("fn"), by)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], *, by: Sequence[str] = (), bins: int = 1024, passes: int = 2) -> DataFrame:
    """by, and a column for each share: exact percentiles, interpolated between neighbouring values.

    Ranks are narrowed down: a pass counts the rows of each group in `bins` bins between two bounds, and only the bins that
    hold a wanted rank, with their own least and greatest value as bounds, go on. After the last pass the distinct values
    inside are counted one by one. So what a task holds is a fixed number of bins, not all values of a group, and a group of
    any size is counted by many tasks. Null and NaN values are left out; a group without others has nulls.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.struct(F.lit(0), *by).alias("_k"), x.alias("_x"))
    facts = rows.groupBy("_k").agg(F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    place = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil))))
    state = facts.where("n > 0").select("_k", F.array(F.struct("lo", "hi", F.lit(0).cast("long").alias("base"), ranks.alias("ranks"))).alias("_open"))

    def counted(state: DataFrame, of: Column) -> DataFrame:
        """Rows by open stretch and `of`, with how many rows of the group stand before, and the wanted ranks inside."""
        inside = F.filter("_open", lambda o: (F.col("_x") >= o["lo"]) & (F.col("_x") <= o["hi"]))
        each = rows.where("_x is not null").join(state, "_k").select("_k", "_x", F.explode(inside).alias("_o")).withColumn("_of", of)
        found = each.groupBy("_k", "_o", "_of").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        line = Window.partitionBy("_k", "_o").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("base", F.col("_o.base") + F.coalesce(F.sum("n").over(line), F.lit(0)))
        return found.withColumn("ranks", F.filter("_o.ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n")))).where(F.size("ranks") > 0)

    wide = F.col("_o.hi") - F.col("_o.lo")
    for _ in range(passes):
        number = F.when(wide > 0, F.least(F.floor((F.col("_x") - F.col("_o.lo")) / wide * bins), F.lit(bins - 1))).otherwise(0)
        state = counted(state, number).groupBy("_k").agg(F.collect_list(F.struct("lo", "hi", "base", "ranks")).alias("_open"))
    values = counted(state, F.col("_x")).select("_k", F.explode("ranks").alias("rank"), F.col("_of").alias("v"))
    known = values.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_v"))
    at = lambda p, f: F.try_element_at("_v", f(p).cast("long"))
    made = [(at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * (p - F.floor(p))).alias(name) for name, p in place.items()]
    return facts.join(known, "_k", "left").select(*(F.col("_k")[c].alias(c) for c in by), *made)


def distribution(df: DataFrame, value: str, *, by: Sequence[str] = (), limits: Sequence[float] = (1.0, 0.99, 0.95, 0.9)) -> DataFrame:
    """Rows, mean, population deviation, extremes, percentiles, and rows below each limit."""
    q = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95}
    found = df.groupBy(F.struct(F.lit(0), *by).alias("_k")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *(F.count_if(F.col(value) < x).alias(f"below_{str(x).replace('.', '_')}") for x in limits),
    )
    ranked = percentiles(df, value, q, by=by).select(F.struct(F.lit(0), *by).alias("_k"), *q)
    columns = ["n_rows", "mean", "std", "min", *q, "max", *(c for c in found.columns if c.startswith("below_"))]
    return found.join(ranked, "_k").select(*(F.col("_k")[c].alias(c) for c in by), *columns)


def dataset_summary(df: DataFrame, levels: Sequence[str], distinct: str) -> DataFrame:
    """Rows and distinct values at every level of a hierarchy, totals included (null stands for all)."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(distinct).alias("n_distinct"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: nulls and distinct values."""
    wide = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns), *(F.countDistinct(c).alias(f"d_{c}") for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_nulls"), F.col(f"d_{c}").alias("n_distinct")) for c in columns))
    return wide.select(F.inline(rows))


def kept_removed(df: DataFrame, removed: Column, *, by: Sequence[str]) -> DataFrame:
    found = df.groupBy(*by).agg(F.count_if(~removed).alias("n_kept"), F.count_if(removed).alias("n_removed"))
    return found.withColumn("removed_share", F.col("n_removed") / (F.col("n_kept") + F.col("n_removed")))


def label_changes(before: DataFrame, after: DataFrame, *, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Counts of label pairs over the rows of either table; a missing side is NO_LABEL."""
    b, a = before.select(*keys, F.col(label).alias("before")), after.select(*keys, F.col(label).alias("after"))
    both = b.join(a, list(keys), "full").fillna("NO_LABEL", ["before", "after"])
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n_rows"))


def best_operating_point(sweep: DataFrame, *, least_recall: float, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first rows in order among those with enough recall."""
    return sweep.where(F.col("recall") >= least_recall).orderBy(*order).limit(n)


def sweep_threshold(df: DataFrame, y: str, probability: str, grid: Sequence[float], *, by: Sequence[str] = ()) -> DataFrame:
    """Metrics at each threshold of a sorted grid: one histogram of rows by the number of thresholds they reach, then
    suffix sums. Each row is read once, however long the grid."""
    grid = sorted(grid)
    reach = F.when(F.col(probability).isNull(), 0).otherwise(sum(((F.col(probability) >= t).cast("int") for t in grid), F.lit(0)))
    known = df.where(F.col(y).isin(0, 1))
    hist = known.groupBy(*by, reach.alias("_reach")).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    points = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)))).alias("_g")
    each = hist.select("*", points)
    above = F.col("_reach") >= F.col("_g.i")
    add = lambda c, flag: F.sum(F.when(flag, F.col(c)).otherwise(0))
    counts = each.groupBy(*by, F.col("_g.threshold").alias("threshold")).agg(add("_pos", above).alias("tp"), add("_neg", above).alias("fp"), add("_pos", ~above).alias("fn"), add("_neg", ~above).alias("tn"))
    return from_counts(counts)


def _run_metrics(df: DataFrame, y: str, flags: Sequence[tuple[dict[str, float], Column]], least: Sequence[int], points: Sequence[dict[str, float]], *, by: Sequence[str], order: Sequence[str], bucket_us: int) -> DataFrame:
    """Metrics of flagged rows in runs of at least min_run rows, for each of the points.

    Rows are sorted once for all flags, by time buckets. A bucket comes down to a histogram of the runs inside it and its
    first and last run for each flag; those of neighbouring buckets that go on into each other are put together, and the
    histograms are added. So no window holds a whole key, and rows are not repeated for each point of the grid.
    """
    names = [f"_f{i}" for i in range(len(flags))]
    kept = df.select(*dict.fromkeys([*by, *order]), F.col(y).alias("_y"), *(F.coalesce(f, F.lit(False)).alias(n) for n, (_, f) in zip(names, flags, strict=True)))
    rows = keyed(kept, by, time_bucket(kept, order[0], bucket_us))
    w, bucket = Window.partitionBy("_k", "_b").orderBy(*order), Window.partitionBy("_k", "_b")
    rows = rows.withColumns({f"_c{i}": F.when(F.lag(n).over(w).isNull() | (F.col(n) == F.lag(n).over(w)), 0).otherwise(1) for i, n in enumerate(names)})
    rows = rows.withColumns({f"_r{i}": F.sum(f"_c{i}").over(w) for i in range(len(names))})
    each = rows.withColumns({f"_t{i}": F.max(f"_r{i}").over(bucket) for i in range(len(names))})
    each = each.select("_k", "_b", "_y", F.posexplode(F.array(*(F.struct(F.col(n).alias("flag"), F.col(f"_r{i}").alias("run"), F.col(f"_t{i}").alias("top")) for i, n in enumerate(names)))).alias("_of", "_x"))
    made = [F.count(F.lit(1)).alias("length"), F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")]
    runs = each.groupBy("_k", "_b", "_of", "_x.run", "_x.flag", "_x.top").agg(*made)
    inside = (F.col("run") > 0) & (F.col("run") < F.col("top"))
    line = Window.partitionBy("_k", "_of").orderBy("_b", "run")
    last = F.lag(F.struct("_b", "flag")).over(line)
    edges = runs.where(~inside).withColumn("_new", F.when((last["_b"] < F.col("_b")) & (last["flag"] == F.col("flag")), 0).otherwise(1))
    edges = edges.withColumn("_island", F.sum("_new").over(line)).groupBy("_k", "_of", "_island", "flag").agg(*(F.sum(c).alias(c) for c in ("length", "pos", "neg")))
    # runs longer than any limit count alike
    found = runs.where(inside).select("_of", "flag", "length", "pos", "neg").unionByName(edges.select("_of", "flag", "length", "pos", "neg"))
    hist = found.groupBy("_of", "flag", F.least("length", F.lit(max(least))).alias("length")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    of = [next(i for i, (p, _) in enumerate(flags) if all(point[k] == v for k, v in p.items())) for point in points]
    grid = F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(k) for k, v in point.items())) for i, point in zip(of, points, strict=True)))
    met = hist.withColumn("_p", F.explode(grid)).where("_p.i = _of")
    hat = F.col("flag") & (F.col("length") >= F.col("_p.min_run"))
    add = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    counts = met.groupBy(*(F.col(f"_p.{k}").alias(k) for k in points[0])).agg(add("pos", hat).alias("tp"), add("neg", hat).alias("fp"), add("pos", ~hat).alias("fn"), add("neg", ~hat).alias("tn"))
    return from_counts(counts)


def sweep_min_run(df: DataFrame, y: str, probability: str, grid: Sequence[tuple[float, int]], *, by: Sequence[str], order: Sequence[str], gate: tuple[str, float] | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """Metrics of thresholded and persistence-filtered predictions for each (threshold, min_run)."""
    also = F.col(gate[0]) >= gate[1] if gate else F.lit(True)
    flags = [({"threshold": t}, (F.col(probability) >= t) & also) for t in sorted({float(t) for t, _ in grid})]
    points = [{"threshold": float(t), "min_run": int(k)} for t, k in grid]
    return _run_metrics(df, y, flags, [k for _, k in grid], points, by=by, order=order, bucket_us=bucket_us)


def sweep_consensus(df: DataFrame, y: str, first: str, second: str, grid: Sequence[tuple[float, float, int]], *, by: Sequence[str], order: Sequence[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Metrics where both probabilities reach their thresholds, then runs are filtered."""
    pairs = sorted({(float(a), float(b)) for a, b, _ in grid})
    flags = [({"first_threshold": a, "second_threshold": b}, (F.col(first) >= a) & (F.col(second) >= b)) for a, b in pairs]
    points = [{"first_threshold": float(a), "second_threshold": float(b), "min_run": int(k)} for a, b, k in grid]
    return _run_metrics(df, y, flags, [k for _, _, k in grid], points, by=by, order=order, bucket_us=bucket_us)


def sweep_hysteresis(df: DataFrame, y: str, probability: str, grid: Sequence[tuple[float, float, int, int]], *, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Metrics for each (enter, exit, enter_run, exit_run) with exit not above enter, all in one plan: a row stands once
    for each point, and the windows of all points share one exchange."""
    points = [{"enter": float(hi), "exit": float(lo), "enter_run": int(k), "exit_run": int(m)} for hi, lo, k, m in grid if lo <= hi]
    columns = list(dict.fromkeys([*by, *order, y, probability]))
    each = df.select(*columns, F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in p.items())) for p in points))))
    keys = ["enter", "exit", "enter_run", "exit_run"]
    made = hysteresis(each, probability, hi=F.col("enter"), lo=F.col("exit"), k=F.col("enter_run"), m=F.col("exit_run"), by=[*keys, *by], order=order, out="_hat")
    return binary_metrics(made, y, "_hat", by=keys)


def ranked_reviews(df: DataFrame, order: Sequence[Column], n: int, prefix: str = "R") -> DataFrame:
    """The first n rows in order with a zero-padded rank id. The rank is taken over these n rows only."""
    top = df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("review_id", F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 4, "0")))


def window_sizes(samples: DataFrame, sizes_s: Sequence[int], *, time: str = "_time", feet: Sequence[str] = ("Left", "Right")) -> DataFrame:
    """For each window size: distinct window centers and the rows of each foot.

    Rows are counted once, in bins as wide as the greatest common divisor of all sizes; those bins, not the rows, are
    rolled up to the windows of each size. Rows without a time count for their foot, not as a center.
    """
    width = math.gcd(*(int(s) for s in sizes_s))
    names = [f"{f.lower()}_rows" for f in feet]
    bins = samples.groupBy(F.floor(times.micros(time) / (width * times.SECOND)).alias("_bin")).agg(*(F.count_if(F.col("foot") == f).alias(n) for f, n in zip(feet, names, strict=True)))
    each = bins.withColumn("window_s", F.explode(F.array(*(F.lit(int(s)) for s in sizes_s))))
    centers = each.groupBy("window_s", F.floor(F.col("_bin") * width / F.col("window_s")).alias("_center")).agg(*(F.sum(n).alias(n) for n in names))
    return centers.groupBy("window_s").agg(F.count("_center").alias("distinct_centers"), *(F.sum(n).alias(n) for n in names))

"""Runs and gaps: time blocks, islands, transitions, persistence, hysteresis and stitched sequences.

Numbers that run over all rows come from counts for each reference and a prefix sum over references, so no window
holds the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times


#: Width of the time buckets that windows run over; a bucket should hold some million rows of a key at most.
BUCKET_US = 86_400 * times.SECOND


def time_bucket(df: DataFrame, column: str, bucket: int) -> Column:
    """Bucket of a row by a time, `bucket` microseconds wide, or by a whole number; all in one where it is neither."""
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.floor(times.micros(column) / bucket)
    return F.floor(F.col(column) / bucket) if kind in ("integer", "long") else F.lit(0).cast("long")


def keyed(df: DataFrame, by: Sequence[str], bucket: Column) -> DataFrame:
    """Rows with `_k`, their keys as one value, and `_b`, their bucket. A row of nulls equals itself as a struct, so that
    windows, sums and joins over both share one exchange of the rows."""
    return df.withColumns({"_k": F.struct(F.lit(0), *by), "_b": bucket})


def numbered(rows: DataFrame, inner: Column, across: Column, *, order: Sequence[str], facts: Column, out: str, place: str | None = None) -> DataFrame:
    """`out`: how many rows up to each one are new, for rows with `_k` and `_b`, however many one key has; and `place`, if
    it is named, the place of each row from 0.

    inner: whether a row is new after the row before it in its bucket, by `_before`, that row's facts (null for the
    first). across: the same for the first row of a bucket, by its facts `_first` and those of the last row before it,
    `_carry`, null for the first of all. Windows hold a bucket; only a row for each bucket passes one over a whole key.
    """
    w = Window.partitionBy("_k", "_b").orderBy(*order)
    rows = rows.withColumn("_facts", facts).withColumn("_before", F.lag("_facts").over(w))
    rows = rows.withColumn("_new", F.when(F.col("_before").isNull(), 0).otherwise(inner.cast("int")))
    at = F.struct(*order)
    ends = rows.groupBy("_k", "_b").agg(F.min_by("_facts", at).alias("_first"), F.max_by("_facts", at).alias("_last"), F.sum("_new").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    buckets = Window.partitionBy("_k").orderBy("_b")
    ends = ends.withColumn("_carry", F.lag("_last").over(buckets)).withColumn("_start", F.when(F.col("_carry").isNull(), 1).otherwise(across.cast("int")))
    before = lambda c: F.coalesce(F.sum(c).over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select("_k", "_b", (before(F.col("_n") + F.col("_start")) + F.col("_start")).alias("_offset"), before("_rows").alias("_above"))
    counted = rows.withColumn("_n", F.sum("_new").over(w))
    if place:
        counted = counted.withColumn(place, F.row_number().over(w) - 1)
    counted = counted.join(offsets, ["_k", "_b"]).withColumn(out, F.col("_offset") + F.col("_n"))
    if place:
        counted = counted.withColumn(place, F.col("_above") + F.col(place))
    return counted.drop("_facts", "_before", "_new", "_n", "_offset", "_above", "_b", "_k")


def row_index(df: DataFrame, *, by: Sequence[str], order: Sequence[str], out: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """`out`: the place of each row within its keys, from 0; windows hold a time bucket each."""
    rows = keyed(df, by, time_bucket(df, order[0], bucket_us))
    sizes = rows.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_k", "_b").orderBy(*order))).join(sizes.select("_k", "_b", before.alias("_offset")), ["_k", "_b"])
    return placed.withColumn(out, F.col("_offset") + F.col("_at") - 1).select(*df.columns, out)


def gap_segments(df: DataFrame, *, by: Sequence[str], time: str, gap_us: int, tie: Sequence[str] = (), out: str = "segment", change: Sequence[str] = (), bucket_us: int = BUCKET_US) -> DataFrame:
    """Number of the segment within its keys, from 1: a gap of more than gap_us, or a change of a column in `change`,
    begins the next."""

    def new(now: Column, before: Column) -> Column:
        found = now["us"] - before["us"] > gap_us
        for i in range(len(change)):
            found = found | ~now[f"c{i}"].eqNullSafe(before[f"c{i}"])
        return found

    us = times.micros(time)
    facts = F.struct(us.alias("us"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(change)))
    rows = keyed(df, by, F.floor(us / bucket_us))
    return numbered(rows, new(F.col("_facts"), F.col("_before")), new(F.col("_first"), F.col("_carry")), order=[time, *tie], facts=facts, out=out)


def global_blocks(segmented: DataFrame, *, by: str = "reference", segment: str = "segment", out: str = "block_id") -> DataFrame:
    """Ids that run on over references in order, from 0, from segment numbers within each."""
    counts = segmented.groupBy(by).agg(F.max(segment).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(by, before.alias("_before"))  # a row for each reference
    return segmented.join(offsets, by).withColumn(out, F.col("_before") + F.col(segment) - 1).drop("_before")


def islands(df: DataFrame, flag: Column, *, by: Sequence[str], order: Sequence[str], out: str = "run", bucket_us: int = BUCKET_US, place: str | None = None) -> DataFrame:
    """Rows with a flag and the number of their run of equal flags within the keys, from 1, and on demand their `place`
    from 0. Where `order` begins with a
    time, keys are cut into buckets of it, so that no task holds a whole key."""
    rows = keyed(df.withColumn("flag", flag), by, time_bucket(df, order[0], bucket_us))
    differ = lambda a, b: ~F.col(a)["flag"].eqNullSafe(F.col(b)["flag"])
    return numbered(rows, differ("_facts", "_before"), differ("_first", "_carry"), order=order, facts=F.struct("flag"), out=out, place=place)


def run_table(df: DataFrame, *, by: Sequence[str], time: str, values: Sequence[Column] = (), least: int = 1, pad_s: float = 0.0) -> DataFrame:
    """Start, stop, windows and duration of each run, and further aggregates."""
    found = df.groupBy(*by).agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count(F.lit(1)).alias("n_windows"), *values)
    return found.where(F.col("n_windows") >= least).withColumn("duration_s", times.seconds_between("run_start", "run_end") + pad_s)


def in_blocks(df: DataFrame, *, by: Sequence[str], order: Sequence[str], halo: int, block: int) -> tuple[DataFrame, Column]:
    """Rows with `_i`, their place within the keys, and `_of`, a block of places, each with `halo` rows more on both
    sides; and which rows are a block's own. Windows over (keys, `_of`) in order of `_i` then see `halo` rows both ways."""
    placed = row_index(df, by=by, order=order, out="_i")
    near = F.sequence(F.floor((F.col("_i") - halo) / block), F.floor((F.col("_i") + halo) / block))
    return placed.withColumn("_of", F.explode(near)), F.floor(F.col("_i") / block) == F.col("_of")


def transition_distance(df: DataFrame, *, by: Sequence[str], time: str, label: str, tie: Sequence[str] = (), out: str = "nearest_transition_s", block: int = 100_000) -> DataFrame:
    """Seconds to a neighbouring row of another label, before or after; null where both neighbours agree.

    Only the two rows that touch a change get a distance. Long segments are cut into blocks of rows.
    """
    rows, own = in_blocks(df, by=by, order=[time, *tie], halo=1, block=block)
    w = Window.partitionBy(*by, "_of").orderBy("_i")
    us = times.micros(time)
    back = F.when(F.lag(label).over(w) != F.col(label), us - F.lag(us).over(w))
    ahead = F.when(F.lead(label).over(w) != F.col(label), F.lead(us).over(w) - us)
    return rows.withColumn(out, F.least(back, ahead) / times.SECOND).where(own).select(*(c for c in df.columns if c != out), out)


def transition_filter(df: DataFrame, margin_s: float, distance: str = "nearest_transition_s") -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows."""
    near = F.coalesce(F.col(distance) <= margin_s, F.lit(False))
    return df.where(~near), df.where(near)


def _with_lengths(df: DataFrame, flag: Column, by: Sequence[str], order: Sequence[str], bucket_us: int, **also: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with `flag`, their bucket, and `_size`, the rows of their whole run of equal flags; and the buckets.

    A bucket is summed up by its first and its last run, flag and length, and by whether these are one run (`_runs` is 0).
    Sums of neighbouring buckets combine: a bucket of one run passes on what reaches it from either side. So a run that
    is as long as its key is counted bucket by bucket, and no row is sent to where its run is. `_left` is what the buckets
    before end with, `_right` what those after begin with. also: further sums of a bucket over its rows, which have
    `_n`, the length of their run inside the bucket, and `_place`.
    """
    rows = keyed(df.withColumn("flag", flag), by, time_bucket(df, order[0], bucket_us))
    w = Window.partitionBy("_k", "_b").orderBy(*order)
    before = F.lag(F.struct("flag")).over(w)
    rows = rows.withColumn("_new", F.when(before.isNull(), 0).otherwise((~F.col("flag").eqNullSafe(before["flag"])).cast("int")))
    rows = rows.withColumn("_run", F.sum("_new").over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_k", "_b", "_run"))).withColumn("_place", F.struct(*order))
    end = F.struct("flag", "_n")
    sums = rows.groupBy("_k", "_b").agg(F.min_by(end, "_place").alias("_first"), F.max_by(end, "_place").alias("_last"), F.max("_run").alias("_runs"), *(c.alias(k) for k, c in also.items()))

    def reach(sums: DataFrame, order: Column, own: str, out: str) -> DataFrame:
        """`out`: flag and length of the run that comes in over the bucket before in this order."""
        line = Window.partitionBy("_k").orderBy(order)
        upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.lag(own).over(line)
        apart = (F.col("_runs") > 0) | last.isNull() | ~F.col(own)["flag"].eqNullSafe(last["flag"])
        sums = sums.withColumns({"_apart": apart, "_sum": F.sum(F.col(own)["_n"]).over(upto)})
        sums = sums.withColumn("_base", F.last(F.when(F.col("_apart"), F.col("_sum") - F.col(own)["_n"]), ignorenulls=True).over(upto))
        ended = F.struct(F.col(own)["flag"].alias("flag"), (F.col("_sum") - F.col("_base")).alias("_n"))
        return sums.withColumn(out, F.lag(ended).over(line)).drop("_apart", "_sum", "_base")

    sums = reach(reach(sums, F.asc("_b"), "_last", "_left"), F.desc("_b"), "_first", "_right")
    met = rows.join(sums.select("_k", "_b", "_runs", "_left", "_right"), ["_k", "_b"])
    met = met.withColumn("_size", F.col("_n") + _joined("_left", F.col("flag"), F.col("_run") == 0) + _joined("_right", F.col("flag"), F.col("_run") == F.col("_runs")))
    return met.drop("_new", "_left", "_right", "_runs"), sums


def _joined(side: str, flag: Column, touches: Column) -> Column:
    """What a neighbouring bucket adds to a run that touches it."""
    return F.when(touches & F.col(side).isNotNull() & F.col(side)["flag"].eqNullSafe(flag), F.col(side)["_n"]).otherwise(0)


def run_lengths(df: DataFrame, flag: Column, *, by: Sequence[str], order: Sequence[str], out: str = "run_length", bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows with `flag` and the rows of the run of equal flags (nulls are equal) that each belongs to."""
    rows, _ = _with_lengths(df, flag, by, order, bucket_us)
    return rows.select(*(c for c in df.columns if c not in ("flag", out)), "flag", F.col("_size").alias(out))


def min_run(df: DataFrame, flag: Column, k: int | Column, *, by: Sequence[str], order: Sequence[str], out: str = "kept", bucket_us: int = BUCKET_US) -> DataFrame:
    """1 for flagged rows in runs of at least k rows (rows, not seconds), else 0."""
    rows, _ = _with_lengths(df, F.coalesce(flag, F.lit(False)), by, order, bucket_us)
    return rows.withColumn(out, (F.col("flag") & (F.col("_size") >= k)).cast("int")).select(*df.columns, *([] if out in df.columns else [out]))


def hysteresis(
    df: DataFrame, probability: str, *, hi: float | Column, lo: float | Column, k: int | Column, m: int | Column, by: Sequence[str], order: Sequence[str], out: str = "state", bucket_us: int = BUCKET_US, block: int = 1000
) -> DataFrame:
    """1 from the first of k values in a row of at least hi up to the first of m in a row below lo, else 0.

    Where lo is not above hi (columns have to keep to that, and be the same within `by`), a run of k values of at least
    hi is 1 as a whole, a run of m values below lo is 0, and any other row carries the state before it. Run lengths go
    over buckets, and so does the last state that is sure. Where lo is above hi, a value may count for both; see
    _alternating. Null and NaN count as 0.
    """
    p = F.coalesce(F.nanvl(F.col(probability).cast("double"), F.lit(0.0)), F.lit(0.0))
    if not isinstance(hi, Column) and lo > hi:
        return _alternating(df, p, hi, lo, k, m, by, order, out, block)
    k, m = (x if isinstance(x, Column) else F.lit(x) for x in (k, m))
    sure = lambda flag, size, k, m: F.when((flag == 1) & (size >= k), 1).when((flag == 0) & (size >= m), 0)
    here = sure(F.col("flag"), F.col("_n"), k, m)
    rows, sums = _with_lengths(df, F.when(p >= hi, 1).when(p < lo, 0), by, order, bucket_us, _sure=F.max_by(here, F.when(here.isNotNull(), F.col("_place"))), _least=F.first(F.struct(k.alias("k"), m.alias("m"))))
    # what a bucket ends with: its last run if that is sure with all it touches, else the last sure one inside, else the first run
    size = lambda own, side, whole: F.col(own)["_n"] + _joined(side, F.col(own)["flag"], F.lit(True)) + F.when(F.col("_runs") == 0, _joined(whole, F.col(own)["flag"], F.lit(True))).otherwise(0)
    ends = [sure(F.col(own)["flag"], size(own, side, other), F.col("_least.k"), F.col("_least.m")) for own, side, other in (("_last", "_right", "_left"), ("_first", "_left", "_right"))]
    buckets = sums.withColumn("_end", F.coalesce(ends[0], "_sure", ends[1]))
    buckets = buckets.select("_k", "_b", F.last("_end", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = rows.withColumn("_state", F.last(sure(F.col("flag"), F.col("_size"), k, m), ignorenulls=True).over(inside)).join(buckets, ["_k", "_b"])
    return made.select(*(c for c in df.columns if c != out), F.coalesce("_state", "_carry", F.lit(0)).cast("int").alias(out))


def _alternating(df: DataFrame, p: Column, hi: float, lo: float, k: int, m: int, by: Sequence[str], order: Sequence[str], out: str, block: int) -> DataFrame:
    """Hysteresis with an exit above the enter: values in between count for both, so runs alone don't tell the state.

    The machine has k + m states: off or on, and how many values in a row have counted towards the change. A row is a map
    of these states into themselves, and so is a block of rows. Maps of blocks give every block its first state; then each
    block goes through its own rows, and max(k, m) - 1 more, which may set or clear its last ones back.
    """
    n = k + m
    steps = []  # the next state for each kind of value (reaches hi, lies below lo) and state
    for up, down in ((False, False), (False, True), (True, False), (True, True)):
        steps += [(s + 1 if up else 0) if s < k else (0 if s + 1 == n else s + 1) if down else k for s in range(n)]
    table = F.array(*(F.lit(s) for s in steps))
    step = lambda s, kind: F.get(table, kind * n + s)
    rows, own = in_blocks(df, by=by, order=order, halo=max(k, m) - 1, block=block)
    kind = 2 * (p >= hi).cast("int") + (p < lo).cast("int")
    listed = rows.withColumns({"_k": F.struct(F.lit(0), *by), "_kind": kind, "_own": own}).where(F.col("_i") >= F.col("_of") * block)
    blocks = listed.groupBy("_k", "_of").agg(F.array_sort(F.collect_list(F.struct("_i", "_kind", "_own"))).alias("_rows"), F.max("_own").alias("_any")).where("_any")
    own_rows = F.filter("_rows", lambda r: r["_own"])
    maps = blocks.withColumn("_map", F.aggregate(own_rows, F.sequence(F.lit(0), F.lit(n - 1)), lambda a, r: F.transform(a, lambda s: step(s, r["_kind"]))))
    line = Window.partitionBy("_k").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    begun = maps.withColumn("_before", F.collect_list("_map").over(line)).withColumn("_start", F.aggregate("_before", F.lit(0), lambda s, x: F.get(x, s)))
    path = F.aggregate("_rows", F.array("_start"), lambda a, r: F.concat(a, F.array(step(F.element_at(a, -1), r["_kind"]))))
    walked = begun.withColumn("_path", path)  # the state before each row, and after the last

    def state(i: Column) -> Column:
        on = lambda j: F.get("_path", i + j) >= k  # noqa: E731  before the j-th row from here
        turns = lambda width, to: F.exists(F.array(*(F.lit(j) for j in range(1, width))), lambda j: F.coalesce((on(j) != to) & (on(j + 1) == to), F.lit(False))) if width > 1 else F.lit(False)
        return F.when(on(1), ~turns(m, F.lit(False))).otherwise(turns(k, F.lit(True))).cast("int")

    each = walked.select("_k", "_rows", F.posexplode(F.transform("_rows", lambda r, i: F.struct(r["_i"].alias("_i"), r["_own"].alias("_own"), state(i).alias("_state")))).alias("_at", "_x")).where("_x._own")
    placed = row_index(df, by=by, order=order, out="_i").withColumn("_k", F.struct(F.lit(0), *by))
    return placed.join(each.select("_k", F.col("_x._i").alias("_i"), F.col("_x._state").alias("_state")), ["_k", "_i"]).select(*(c for c in df.columns if c != out), F.col("_state").cast("int").alias(out))


def stitched(df: DataFrame, segments: DataFrame, *, on: Sequence[str], order: str, time: str, tie: Sequence[str] = (), out: str = "position", bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows of listed segments in segment order with one running number, from 1: the place within each segment, which time
    buckets give, plus the rows of the segments before."""
    sizes = df.join(segments.select(*on, order), list(on)).groupBy(*on, order).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*on, order, before.alias("_before"))  # a row for each segment
    placed = row_index(df, by=on, order=[time, *tie], out="_i", bucket_us=bucket_us)
    return placed.join(offsets, list(on)).withColumn(out, F.col("_before") + F.col("_i") + 1).drop("_before", "_i")


def context_sequences(df: DataFrame, *, by: Sequence[str], order: str, features: Sequence[str], length: int, tie: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """`sequence`: features of the length//2 rows on both sides of each row, with the first and last time; rows too
    near to an end of their block go. Recordings are cut into blocks of rows, with length//2 more on both sides."""
    if length < 3 or length % 2 == 0:
        raise ValueError("length must be odd and at least 3")
    h = length // 2
    blocks, own = in_blocks(df, by=by, order=[order, *tie], halo=h, block=block)
    w = Window.partitionBy(*by, "_of").orderBy("_i")
    rows = blocks.withColumns({
        "sequence": F.collect_list(F.array(*(F.col(c).cast("double") for c in features))).over(w.rowsBetween(-h, h)),
        "seq_start": F.lag(order, h).over(w),
        "seq_stop": F.lead(order, h).over(w),
    })
    return rows.where(own & (F.size("sequence") == length)).select(*df.columns, "sequence", "seq_start", "seq_stop")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")

"""Joins of points and intervals, overlaps, and intervals cut into pieces.

A point meets an interval by reference and a time bucket: intervals are exploded into the buckets that they
touch, so that the join is an equi join at any size, and the exact bounds filter what remains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times
from motionlake.functions.labels import NO_LABEL

DAY_US = 86_400 * times.SECOND


def _bucket(us: Column, width: int) -> Column:
    return F.floor(us / width).cast("long")


def in_buckets(intervals: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """A row for each bucket that an interval touches, both ends included."""
    low, high = _bucket(times.micros(start), width), _bucket(times.micros(stop), width)
    return intervals.where(F.col(start) <= F.col(stop)).withColumn("_bucket", F.explode(F.sequence(low, high)))


def label_points(
    points: DataFrame, labels: DataFrame, *, on: str = "reference", time: str = "_time", overlap: str = "first", order: Sequence[str] = ("start", "stop", "label"), offset_s: float = 0, default: str = NO_LABEL, width_us: int = DAY_US
) -> DataFrame:
    """`label` of the half-open interval [start, stop) around each point.

    Where intervals overlap the first or the last in `order` wins; a point in none gets the default. offset_s
    shifts all intervals. The intervals of a reference that touch a bucket are one row, so points are shuffled once, or
    not at all where Spark broadcasts those rows.
    """
    shift = F.lit(int(offset_s * times.SECOND))
    ranked = labels.withColumn("_rank", F.struct(*order))
    if offset_s:
        ranked = ranked.withColumns({c: times.from_micros(times.micros(c) + shift) for c in ("start", "stop")})
    dealt = in_buckets(ranked.where("start < stop").select(F.col(on).alias("_on"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("label").alias("_label"), "_rank"), "_start", "_stop", width_us)
    near = dealt.groupBy("_on", F.col("_bucket").alias("_of")).agg(F.collect_list(F.struct("_rank", "_label", "_start", "_stop")).alias("_near"))
    timed = points.withColumn("_bucket", _bucket(times.micros(time), width_us))
    met = timed.join(near, (timed[on] == near["_on"]) & (timed["_bucket"] == near["_of"]), "left")
    around = F.filter("_near", lambda x: (F.col(time) >= x["_start"]) & (F.col(time) < x["_stop"]))
    best = (F.array_min if overlap == "first" else F.array_max)(around)["_label"]
    return met.withColumn("label", F.coalesce(best, F.lit(default))).select(*(c for c in points.columns if c != "label"), "label")


def exclude_windows(windows: DataFrame, exclusions: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Windows that equal no exclusion on all keys."""
    return windows.join(exclusions.select(*keys).distinct(), list(keys), "left_anti")


def _inside(points: DataFrame, intervals: DataFrame, on: Sequence[str], time: str, how: str, width_us: int) -> DataFrame:
    dealt = in_buckets(intervals.select(*on, F.col("start").alias("_start"), F.col("stop").alias("_stop")), "_start", "_stop", width_us)
    timed = points.withColumn("_bucket", _bucket(times.micros(time), width_us))
    same = [timed[c] == dealt[c] for c in (*on, "_bucket")]
    within = (timed[time] >= dealt["_start"]) & (timed[time] <= dealt["_stop"])
    return timed.join(dealt, [*same, within], how).drop("_bucket")


def exclude_points(points: DataFrame, exclusions: DataFrame, *, on: Sequence[str] = ("reference",), time: str = "_time", width_us: int = DAY_US) -> DataFrame:
    """Points in no closed interval [start, stop] of the same keys (reference, and segment bounds if wanted)."""
    return _inside(points, exclusions, on, time, "left_anti", width_us)


def points_inside(points: DataFrame, intervals: DataFrame, *, on: Sequence[str] = ("reference",), time: str = "_time", width_us: int = DAY_US) -> DataFrame:
    """Points in some closed interval of the same keys."""
    return _inside(points, intervals, on, time, "left_semi", width_us)


def interval_overlaps(intervals: DataFrame, *, by: str = "reference", start: str = "start", stop: str = "stop", tie: Sequence[str] = ()) -> DataFrame:
    """Intervals that begin before the previous one of their reference ends, with its end."""
    order = Window.partitionBy(by).orderBy(start, stop, *tie)
    return intervals.withColumn("previous_stop", F.lag(stop).over(order)).where(F.col(start) < F.col("previous_stop"))


class _Longest:
    """Intervals still there, in order: of every stretch of them (a node of a binary tree) the greatest length and its
    label, and the greatest length of any other label. Finds the next interval of another label that is long enough, and
    takes intervals out, in logarithmic time."""

    GONE = -(2**63)

    def __init__(self, lengths: np.ndarray, labels: np.ndarray):
        self.size = 1 << max(1, (len(lengths) - 1).bit_length())
        self.top, self.label, self.other = ([v] * (2 * self.size) for v in (self.GONE, -2, self.GONE))
        self.top[self.size : self.size + len(lengths)] = lengths.tolist()
        self.label[self.size : self.size + len(labels)] = labels.tolist()
        for node in range(self.size - 1, 0, -1):
            self._join(node)

    def _join(self, node: int) -> None:
        a, b = sorted((2 * node, 2 * node + 1), key=self.top.__getitem__)
        self.top[node], self.label[node] = self.top[b], self.label[b]
        self.other[node] = max(self.other[b], self.top[a] if self.label[a] != self.label[b] else self.other[a])

    def _best(self, node: int, label: int) -> int:
        return self.top[node] if self.label[node] != label else self.other[node]

    def take(self, i: int) -> None:
        node = i + self.size
        self.top[node] = self.GONE
        while node > 1:
            node //= 2
            self._join(node)

    def next(self, low: int, high: int, label: int, least: int) -> int:
        """The first place in [low, high) of another label and at least this length; high if there is none."""
        if low >= high:
            return high
        node = low + self.size
        while self._best(node, label) < least:
            while node & 1:
                node //= 2
            if not node:
                return high
            node += 1
        while node < self.size:
            node *= 2
            if self._best(node, label) < least:
                node += 1
        return min(node - self.size, high)


def _sweep(start: np.ndarray, stop: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which intervals go, for intervals in order, labels as numbers. Each interval that is still there meets those that
    begin before it ends: the first of another label that is as long or longer ends it, and all others of another label
    before that one go. Every step takes an interval out, so all of it is n log n."""
    length, gone = stop - start, np.zeros(len(start), bool)
    there, until = _Longest(length, label), np.searchsorted(start, stop, side="left")
    for i in range(len(start)):
        if gone[i]:
            continue
        winner = there.next(i + 1, int(until[i]), int(label[i]), int(length[i]))
        j = there.next(i + 1, winner, int(label[i]), _Longest.GONE + 1)
        while j < winner:
            gone[j] = True
            there.take(j)
            j = there.next(j + 1, winner, int(label[i]), _Longest.GONE + 1)
        if winner < until[i]:
            gone[i] = True
    return gone


def resolve_conflicts(intervals: DataFrame, *, by: str = "reference", label: str = "label", start: str = "start", stop: str = "stop") -> DataFrame:
    """`dropped` for each interval: pairs of overlapping, differently labelled intervals are met in order of (start, stop,
    label), the shorter goes (of equal ones the earlier), and what has gone no longer counts.

    Chains of overlapping intervals, cut by the latest stop so far, do not touch each other; each is swept in one
    task. Most chains are one interval or agree in label and need none. Null labels are equal; an interval without a start
    or stop meets no other.
    """
    from pyspark.sql.types import BooleanType, StructField, StructType

    schema = StructType([*intervals.schema.fields, StructField("dropped", BooleanType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (start, stop, label)]).drop_columns(["_cell"])
        bounds = [table[c].cast(pa.int64()).to_numpy() for c in (start, stop)]
        names = table[label].combine_chunks().dictionary_encode().indices
        gone = _sweep(*bounds, np.asarray(names.fill_null(-1).to_numpy(zero_copy_only=False), np.int64))
        return table.append_column("dropped", pa.array(gone))

    whole = intervals.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    order = Window.partitionBy(by).orderBy(start, stop, F.col(label).asc_nulls_last())
    latest = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) >= latest).cast("int"), F.lit(0))
    chained = whole.withColumn("_chain", new).withColumn("_chain", F.sum("_chain").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = Window.partitionBy(by, "_chain")
    known = F.count(label).over(chain)
    alike = F.min(label).over(chain).eqNullSafe(F.max(label).over(chain)) & ((known == F.count(F.lit(1)).over(chain)) | (known == 0))
    # chains of one reference do not touch each other, so short ones share a cell
    cell = F.floor(F.min("_at").over(chain) / 10_000)
    rows = chained.withColumn("_at", F.row_number().over(order)).withColumns({"_alike": alike, "_cell": cell})
    calm = rows.where("_alike").select(*intervals.columns, F.lit(False).alias("dropped"))
    open_ = intervals.where(F.col(start).isNull() | F.col(stop).isNull()).withColumn("dropped", F.lit(False))
    return calm.unionByName(open_).unionByName(rows.where("not _alike").drop("_alike", "_chain", "_at").groupBy(by, "_cell").applyInArrow(run, schema))


def shifted(candidates: DataFrame, offsets_minutes: Sequence[int], start: str = "start", stop: str = "stop") -> DataFrame:
    """Each candidate under each offset: the list of offsets is part of the plan, no join is needed."""
    rows = candidates.withColumn("offset_minutes", F.explode(F.array(*(F.lit(int(m)) for m in offsets_minutes))))
    move = F.col("offset_minutes").cast("long") * (60 * times.SECOND)
    return rows.withColumns({f"shifted_{start}": times.from_micros(times.micros(start) + move), f"shifted_{stop}": times.from_micros(times.micros(stop) + move)})


def split_intervals(df: DataFrame, max_s: float, min_s: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """Pieces of at most max_s seconds with their number; pieces shorter than min_s go."""
    most = int(max_s * times.SECOND)
    low, high = times.micros(start), times.micros(stop)
    rows = df.where(F.col(start) < F.col(stop)).withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.ceil((high - low) / most) - 1).cast("int"))))
    begin = low + F.col("chunk").cast("long") * most
    rows = rows.withColumns({"piece_start": times.from_micros(begin), "piece_stop": times.from_micros(F.least(begin + most, high))})
    return rows.where(times.micros("piece_stop") - times.micros("piece_start") >= int(min_s * times.SECOND))


def tile_intervals(df: DataFrame, step_s: float, start: str = "start", stop: str = "stop", zone: str = "UTC") -> DataFrame:
    """Tiles of step_s seconds, the last one cut, with local and UTC texts of their bounds."""
    tiles = split_intervals(df, step_s, 0, start, stop).withColumnsRenamed({"chunk": "tile", "piece_start": "tile_start", "piece_stop": "tile_stop"})
    form = "yyyy-MM-dd HH:mm:ss"
    return tiles.withColumns({
        "tile_from_local": F.date_format(times.to_local(F.col("tile_start"), zone), form),
        "tile_until_local": F.date_format(times.to_local(F.col("tile_stop"), zone), form),
        "tile_from_utc": times.rfc3339(F.col("tile_start")),
        "tile_until_utc": times.rfc3339(F.col("tile_stop")),
    })


def spread_blocks(df: DataFrame, k: int, length_s: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """k blocks of length_s seconds spread evenly from the first to the last possible start, floored to seconds; an
    interval that is no longer than a block has one, at its start."""
    length = int(length_s * times.SECOND)
    low, high = times.micros(start), times.micros(stop)
    free = high - low - length
    rows = df.where(F.col(start) < F.col(stop)).withColumn("block", F.explode(F.sequence(F.lit(0), F.when(free > 0, k - 1).otherwise(0))))
    at = low + F.when(free > 0, F.col("block") * free / max(k - 1, 1)).otherwise(0)
    begin = (F.floor(at / times.SECOND) * times.SECOND).cast("long")
    return rows.withColumns({"block_start": times.from_micros(begin), "block_stop": times.from_micros(F.least(begin + length, F.greatest(high, begin)))})


def core_chunks(df: DataFrame, chunk_s: float, halo_s: float, start: str = "start", stop: str = "stop") -> DataFrame:
    """Pieces with a halo on both sides: core bounds for what is kept, query bounds for what is read."""
    rows = split_intervals(df, chunk_s, 0, start, stop).withColumnsRenamed({"piece_start": "core_start", "piece_stop": "core_stop"})
    halo = int(halo_s * times.SECOND)
    return rows.withColumns({"query_start": times.from_micros(times.micros("core_start") - halo), "query_stop": times.from_micros(times.micros("core_stop") + halo)})


def with_halo(samples: DataFrame, time: str, bucket_us: int, halo_us: int) -> DataFrame:
    """Each sample in its own bucket, and again (`halo` true) in a neighbour that it is near to. Window operators can
    then run by bucket, however many rows one reference has; rows with halo are dropped afterwards."""
    us = times.micros(time)
    own = _bucket(us, bucket_us)
    near = F.sequence(_bucket(us - halo_us, bucket_us), _bucket(us + halo_us, bucket_us))
    return samples.withColumn("bucket", F.explode(near)).withColumn("halo", F.col("bucket") != own)


def keep_core(df: DataFrame, center: str = "time_center", start: str = "core_start", stop: str = "core_stop") -> DataFrame:
    """Rows whose center lies in the half-open core."""
    return df.where((F.col(center) >= F.col(start)) & (F.col(center) < F.col(stop)))


def asof_nearest(left: DataFrame, right: DataFrame, *, on: str, key: str, by: str = "reference", tolerance_us: int, right_columns: Sequence[str], tie: str, bucket_us: int = DAY_US) -> DataFrame:
    """Each left row (unique `key`) with the nearest right row of its reference within the tolerance, both included.

    At equal distance the earlier row wins, then the larger `tie`. Left rows without a match, a time or a reference go.
    Both sides stand in one table, once each, sorted by time buckets: a left row takes the last right row before it and
    the next one behind it. Where its bucket has none, it is the last of the buckets before or the first of those after,
    which one row for each bucket carries over. So rows are shuffled once, and no reference is one task.
    """
    kept = F.struct(F.col(on).alias("time"), F.col(tie).alias("tie"), *(F.col(c).alias(f"right_{c}") for c in right_columns))
    own = left.withColumn("_row", F.struct(*left.columns))
    sides = own.select(F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), "_row", F.lit(None).cast(right.select(kept).schema[0].dataType).alias("_right"))
    other = right.select(F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), kept.alias("_right"))
    rows = sides.unionByName(other).where(F.col("_by").isNotNull() & F.col("_at").isNotNull()).withColumn("_b", _bucket(times.micros("_at"), bucket_us))
    # of right rows at one time the larger tie comes last in either direction; a left row sees those of its own time as before it
    forth = [F.asc("_at"), F.asc("_side"), F.asc("_tie")]
    back = [F.desc("_at"), F.desc("_side"), F.asc("_tie")]
    there = rows.where("_side = 0").groupBy("_by", "_b").agg(F.max_by("_right", F.struct("_at", "_tie")).alias("_last"), F.max_by("_right", F.struct(-times.micros("_at"), "_tie")).alias("_first"))
    buckets = rows.select("_by", "_b").distinct().join(there, ["_by", "_b"], "left")
    line = Window.partitionBy("_by").orderBy("_b")
    carried = buckets.select(
        "_by", "_b", F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_left_of"), F.first("_first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_right_of")
    )
    inside = lambda order: F.last("_right", ignorenulls=True).over(Window.partitionBy("_by", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumns({"_p": inside(forth), "_n": inside(back)}).where("_side = 1").join(carried, ["_by", "_b"])
    met = met.withColumns({"_p": F.coalesce("_p", "_left_of"), "_n": F.coalesce("_n", "_right_of")})
    away = lambda c: F.abs(times.micros(F.col(c)["time"]) - times.micros("_at"))
    met = met.withColumn("_m", F.when(F.col("_n").isNull() | (away("_p") <= away("_n")), F.col("_p")).otherwise(F.col("_n")))
    return met.where(away("_m") <= tolerance_us).select("_row.*", F.col("_m.time").alias("right_time"), *(F.col(f"_m.right_{c}") for c in right_columns))


def _training_rows(rows: DataFrame, folds: DataFrame, by: str, seconds: float, hit) -> DataFrame:
    """Each row once for each fold in whose training set it belongs.

    The spans that a fold tests are kept by reference, so that a row meets only those of its own, by an equi join; the
    list of folds is one row.
    """
    e = int(seconds * times.SECOND)
    span = F.struct("fold", (times.micros("start") - e).alias("low"), (times.micros("stop") + e).alias("high"))
    tested = folds.select(F.col(by).alias("_test"), span.alias("_span")).groupBy("_test").agg(F.collect_list("_span").alias("_spans"))
    listed = folds.agg(F.array_sort(F.collect_set("fold")).alias("_folds"))
    met = rows.join(tested, rows[by] == tested["_test"], "left").crossJoin(F.broadcast(listed))  # one row
    out = F.transform(F.filter(F.coalesce("_spans", F.array().cast(tested.schema["_spans"].dataType)), hit), lambda x: x["fold"])
    return met.withColumn("fold", F.explode(F.array_except("_folds", out))).drop("_test", "_spans", "_folds")


def embargo(rows: DataFrame, folds: DataFrame, *, by: str = "reference", time: str = "_time", seconds: float) -> DataFrame:
    """Training rows of each fold: all rows but those of the fold's test references within [start - e, stop + e].

    folds: fold, reference, start, stop, a row for each test reference of a fold.
    """
    us = times.micros(time)
    return _training_rows(rows, folds, by, seconds, lambda x: (us >= x["low"]) & (us <= x["high"]))


def sequence_embargo(sequences: DataFrame, folds: DataFrame, *, by: str = "reference", start: str = "seq_start", stop: str = "seq_stop", seconds: float) -> DataFrame:
    """As embargo, for rows that span [seq_start, seq_stop]: overlap with a widened test span removes them."""
    low, high = times.micros(start), times.micros(stop)
    return _training_rows(sequences, folds, by, seconds, lambda x: (low <= x["high"]) & (high >= x["low"]))

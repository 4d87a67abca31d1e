"""Leave one block out with a single pass: an ensemble whose structure no label decides.

A fern asks `depth` fixed questions, each whether a feature is above its mean by some deviations, and so sends a row to
one of 2^depth leaves. Nothing but the counts of classes in leaves depends on labels, so they are sufficient statistics:
the model without a test block is the counts of all rows less those of the rows that the block holds out. One grouping
serves every block and every label offset; no model is fitted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from motionlake.functions import times
from motionlake.functions.labels import NO_LABEL
from motionlake.functions.labels import target as target_of
from motionlake.operators import folds, intervals, metrics, segments
from motionlake.sources import sinks

#: Deviations from the mean at which questions cut.
CUTS = (-1.5, -1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0, 1.5)
#: A vote is a share of a million, so that sums are whole numbers in any order.
MILLION = 1_000_000


def questions(n_features: int, trees: int = 150, depth: int = 5, seed: int = 42) -> list[list[tuple[int, float]]]:
    """(feature, cut) of each question of each fern, by the seed alone."""
    rng = np.random.default_rng(seed)
    return [[(int(rng.integers(n_features)), CUTS[int(rng.integers(len(CUTS)))]) for _ in range(depth)] for _ in range(trees)]


def cells(df: DataFrame, features: Sequence[str], out: str = "cell") -> DataFrame:
    """How many cuts each feature is above: all that questions ask of a row. Rows with a null or NaN feature go; means and
    deviations are those of the others."""
    whole = df.dropna(subset=list(features))
    facts = whole.agg(*(f(F.col(c).cast("double")).alias(f"_{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    rows = whole.crossJoin(F.broadcast(facts))  # one row of means
    above = [sum(((F.col(c).cast("double") > F.col(f"_m{i}") + F.lit(z) * F.col(f"_s{i}")).cast("int") for z in CUTS), F.lit(0)) for i, c in enumerate(features)]
    return rows.withColumn(out, F.array(*above)).drop(*facts.columns)


def leaves_of(cell: Column, asked: Sequence[Sequence[tuple[int, float]]]) -> Column:
    """The leaf in each fern, from a cell."""
    ferns = F.array(*(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(CUTS.index(z)).alias("cut")) for f, z in q)) for q in asked))
    return F.transform(ferns, lambda fern: F.aggregate(fern, F.lit(0), lambda n, q: n * 2 + (F.get(cell, q["f"]) > q["cut"]).cast("int")))


def leaves(df: DataFrame, features: Sequence[str], asked: Sequence[Sequence[tuple[int, float]]], out: str = "leaves") -> DataFrame:
    """The leaf of each row in each fern, of rows that `cells` keeps."""
    return cells(df, features, "_cell").withColumn(out, leaves_of(F.col("_cell"), asked)).drop("_cell")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _in_leaves(cell: np.ndarray, asked: Sequence[Sequence[tuple[int, float]]]) -> np.ndarray:
    """leaves_of for many cells."""
    out = np.zeros((len(cell), len(asked)), np.int64)
    for place in zip(*asked, strict=True):
        out = out * 2 + (cell[:, [f for f, _ in place]] > np.array([CUTS.index(z) for _, z in place]))
    return out


def block_votes(rows: DataFrame, *, by: str, block: str, target: str, pattern: str, held: str, models: Sequence[str], asked: Sequence[Sequence[tuple[int, float]]] | None = None) -> DataFrame:
    """models, by, block, pattern, n and ones (rows of it, those of class 1), walking_probability, as leave_block_out tells.

    pattern: a column of leaves, or of cells if the questions `asked` are given. Rows of a block with equal patterns are one
    row with counts. Those counts are written once; the classes of all leaves, a number for each model, fern and leaf, are
    summed from them. Then a block's counts pass a task in order: first those that it holds out, which fill two numbers for
    each leaf, then its own, which are judged at once. No state grows with a block, and no row is repeated for each fern.
    """
    kind, key = list(models), [*models, by, block]
    mine, one = F.col("_own").eqNullSafe(F.col(block)), F.col(target) == 1
    each = rows.select(*kind, by, F.col(block).alias("_own"), F.explode(held).alias(block), target, pattern).dropna(subset=key)
    counted = each.groupBy(*key, pattern).agg(F.count(F.lit(1)).alias("n_out"), F.count_if(one).alias("ones_out"), F.count_if(mine).alias("n"), F.count_if(mine & one).alias("ones"))
    found = sinks.written(counted, "ferns")
    known = found.groupBy(*kind, pattern).agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))  # each row is its own block's once
    of = leaves_of(F.col(pattern), asked) if asked else F.col(pattern)
    total = known.select(*kind, "n", "ones", F.posexplode(of).alias("fern", "leaf")).groupBy(*kind, "fern", "leaf").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()
    width, ferns = 1 + max((r.leaf for r in total), default=0), 1 + max((r.fern for r in total), default=0)
    numbers = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[: len(kind)]) for r in total))}
    all_n, all_ones = (np.zeros((max(len(numbers), 1), ferns * width), np.int64) for _ in range(2))
    for r in total:
        at = numbers[tuple(r[: len(kind)])], r.fern * width + r.leaf
        all_n[at], all_ones[at] = r.n, r.ones
    size = ferns * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((2, size), np.int64)  # counts of the block that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            start, own = (column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_start", "_own"))
            learned = [column(c).to_numpy() for c in ("n_out", "ones_out")]
            model = np.array([numbers[k] for k in zip(*(column(c).to_pylist() for c in kind), strict=True)]) if kind else np.zeros(len(own), np.int64)
            code = _in_leaves(_matrix(column(pattern)), asked) if asked else _matrix(column(pattern)).astype(np.int64)
            code = code + np.arange(ferns) * width
            number, said, at = np.cumsum(start), np.zeros(len(own)), 0
            while at < len(own):
                end = int(np.searchsorted(number, number[at] + max(1, 2_000_000 // size)))
                here, b = slice(at, end), number[at:end] - number[at]
                flat, lives = b[:, None] * size + code[here], ~own[here]
                out = np.zeros((2, int(b[-1]) + 1, size), np.int64)
                for x, w in zip(out, learned, strict=True):
                    x += np.bincount(flat[lives].ravel(), np.repeat(w[here][lives], ferns), x.size).astype(np.int64).reshape(x.shape)
                if not start[at]:
                    out[:, 0] += carry
                carry = out[:, -1].copy()
                asks, leaf = flat[own[here]], code[here][own[here]]
                of_model = model[here][own[here]][:, None]
                less = [x.ravel()[asks] for x in out]
                votes = (MILLION * (all_ones[of_model, leaf] - less[1] + 1)) // (all_n[of_model, leaf] - less[0] + 2)
                said[np.flatnonzero(own[here]) + at] = votes.sum(1) / (ferns * MILLION)
                at = end
            keep = pa.array(own)
            yield pa.RecordBatch.from_arrays([*(column(c).filter(keep) for c in [*key, pattern, "n", "ones"]), pa.array(said[own])], names=[*key, pattern, "n", "ones", "walking_probability"])

    turns = F.explode(F.when(F.col("n") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_own")
    line = found.select("*", turns).withColumn("_start", F.row_number().over(Window.partitionBy(*key).orderBy("_own")) == 1)
    schema = StructType([found.schema[c] for c in [*key, pattern, "n", "ones"]]).add("walking_probability", "double")
    return line.mapInArrow(run, schema)


def leave_block_out(rows: DataFrame, *, by: str, block: str = "block", target: str = "target", leaves: str = "leaves", held: str = "held", models: Sequence[str] = ()) -> DataFrame:
    """Rows with `walking_probability`, the mean share of class 1 in a row's leaves over all rows that its block does not
    hold out, one row of each class added to every leaf.

    by, block: the test block of a row; held: the blocks of the same `by` that must not learn from it (folds.held_out, the
    own block included). `models`: columns with a model each, such as offsets. Rows with a null key are left out.
    """
    key = [*models, by, block, leaves]
    votes = block_votes(rows, by=by, block=block, target=target, pattern=leaves, held=held, models=models)
    return rows.join(votes.select(*key, "walking_probability"), key).select(*rows.columns, "walking_probability")


def sweep_offsets(points: DataFrame, labels: DataFrame, features: Sequence[str], offsets_s: Sequence[float], *, gap_s: float = 5.0, embargo_s: float = 15.0, trees: int = 150, depth: int = 5, seed: int = 42, threshold: float = 0.5, by: str = "reference", time: str = "_time", tie: Sequence[str] = ()) -> DataFrame:
    """offset_s, blocks and metrics under labels shifted by each offset; every time block is left out in its turn.

    Labelled windows fall into blocks, parted by gaps of more than gap_s; what lies within embargo_s of a block, ends
    included, does not teach it. Offsets are part of the key, so one plan serves all of them. An offset without labelled
    rows has no row.
    """
    shifts = F.explode(F.array(*(F.lit(float(x)) for x in offsets_s))).alias("offset_s")
    asked = questions(len(features), trees, depth, seed)
    each = cells(points, features).select(by, time, *tie, "cell", shifts).withColumn("_key", F.struct("offset_s", by))
    us = lambda c: times.from_micros(times.micros(c) + (F.col("offset_s") * times.SECOND).cast("long")).alias(c)
    moved = labels.select("*", shifts).select(F.struct("offset_s", by).alias("_key"), us("start"), us("stop"), "label")
    rows = intervals.label_points(each, moved, on="_key", time=time, overlap="last").where(F.col("label") != NO_LABEL).withColumn("target", target_of(F.col("label")).cast("int"))
    rows = segments.gap_segments(rows, by=["_key"], time=time, tie=tie, gap_us=int(gap_s * times.SECOND), out="block")
    rows = folds.held_out(rows, by="_key", block="block", time=time, seconds=embargo_s)
    votes = block_votes(rows, by="_key", block="block", target="target", pattern="cell", held="held", models=["offset_s"], asked=asked)
    hat, ones, zeros = F.col("walking_probability") >= threshold, F.col("ones"), F.col("n") - F.col("ones")
    add = lambda n, on: F.sum(F.when(on, n).otherwise(0))
    blocks = votes.groupBy("offset_s", "_key", "block").agg(add(ones, hat).alias("tp"), add(zeros, hat).alias("fp"), add(ones, ~hat).alias("fn"), add(zeros, ~hat).alias("tn")).groupBy("offset_s")
    return metrics.from_counts(blocks.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.count(F.lit(1)).alias("blocks")))

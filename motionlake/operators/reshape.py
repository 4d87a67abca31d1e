"""Unions, differences, pivots and wide tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.contracts import require_same_schema


def union_distinct(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates()


def union_keep_first(tables: dict[str, DataFrame], keys: Sequence[str] | None = None, source: str = "dataset_source", tie: Sequence[str] = ()) -> DataFrame:
    """Tables of one schema tagged by name; of rows that agree on the keys (all columns if none) the first table's stays."""
    frames = list(tables.items())
    for _, t in frames[1:]:
        require_same_schema(frames[0][1], t)
    keys = list(keys or frames[0][1].columns)
    out = None
    for i, (name, t) in enumerate(frames):
        t = t.withColumns({source: F.lit(name), "_order": F.lit(i)})
        out = t if out is None else out.unionByName(t)
    ranked = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_order", *tie)))
    return ranked.where("_rank = 1").drop("_rank", "_order")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of their key."""
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def table_diff(left: DataFrame, right: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """One row: common keys, keys of one side only, and the largest absolute difference."""
    l = left.select(*keys, F.col(value).alias("_l"), F.lit(True).alias("_in_l"))  # noqa: E741
    r = right.select(*keys, F.col(value).alias("_r"), F.lit(True).alias("_in_r"))
    both = l.join(r, list(keys), "full")
    here, there = F.col("_in_l").isNotNull(), F.col("_in_r").isNotNull()
    return both.agg(F.count_if(here & there).alias("n_common"), F.count_if(here & ~there).alias("n_left_only"), F.count_if(there & ~here).alias("n_right_only"), F.max(F.abs(F.col("_l") - F.col("_r"))).alias("max_abs_diff"))


def union_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Metric tables of different runs in one schema; what a run lacks is null."""
    out = None
    for name, t in reports.items():
        t = t.withColumn("report", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def to_wide(long: DataFrame, *, keys: Sequence[str], name: Column, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each value for each listed name, as columns {name}_{value}. Names are given, so one aggregate does."""
    rows = long.withColumn("_name", name)
    return rows.groupBy(*keys).agg(*(F.avg(F.when(F.col("_name") == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values))


def to_unilateral(wide: DataFrame, *, keys: Sequence[str], foot: str | None = "foot") -> DataFrame:
    """A row for each foot from columns left_* and right_*: features that both have, and the foot if wanted."""
    sides = {s: {m[1]: c for c in wide.columns if (m := re.fullmatch(rf"{s}_(.+)", c))} for s in ("left", "right")}
    common = [f for f in sides["left"] if f in sides["right"]]
    rows = F.array(*(F.struct(F.lit(s.capitalize()).alias(foot or "_foot"), *(F.col(sides[s][f]).alias(f) for f in common)) for s in sides))
    out = wide.select(*keys, F.inline(rows))
    return out if foot else out.drop("_foot")


def pivot_metrics(df: DataFrame, *, keys: Sequence[str], label: str, labels: Sequence[str], value: str) -> DataFrame:
    """Count and sum of each label as columns."""
    made = []
    for x in labels:
        own = F.col(label) == x
        made += [F.count_if(own).alias(f"n_{x}"), F.coalesce(F.sum(F.when(own, F.col(value))), F.lit(0.0)).alias(f"sum_{x}")]
    return df.groupBy(*keys).agg(*made)


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def attach_metadata(wide: DataFrame, metadata: DataFrame, *, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Metadata by key, one row for each key (the least), so that no row is doubled."""
    one = metadata.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_m"))
    return wide.join(one, list(keys), "left").select(*wide.columns, *(F.col(f"_m.{c}").alias(c) for c in columns))

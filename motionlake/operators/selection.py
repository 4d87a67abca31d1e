"""Selection of segments and roles of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.operators.intervals import exclude_windows


def select_segments(segments: DataFrame, exclusions: DataFrame | None = None, *, scope: str = "all", keys: Sequence[str] = ("reference", "from_time", "until_time")) -> DataFrame:
    """Segments for evaluation: none excluded, use_for_sequence_eval set, of seen or new patients if asked (`same`,
    `new`), with valid coverage; their original order stays as order_index."""
    rows = exclude_windows(segments, exclusions, keys=keys) if exclusions is not None else segments
    rows = rows.where(F.col("use_for_sequence_eval") & F.col("coverage_status").isin("valid", "valid_both_feet"))
    if scope != "all":
        rows = rows.where(F.col("seen_patient") if scope == "same" else ~F.col("seen_patient"))
    return rows


def assign_roles(windows: DataFrame, *, most_s: float = 600.0) -> DataFrame:
    """Long negative windows leave the training set but stay for evaluation; why a window left is told."""
    long_negative = (F.col("label") == "not_walking") & (F.col("duration_s") > most_s)
    dropped = F.col("dropped") if "dropped" in windows.columns else F.lit(False)
    return windows.withColumns({
        "use_for_main_dataset": ~long_negative & ~dropped,
        "use_for_sequence_eval": ~dropped,
        "drop_reason": F.when(dropped, "overlap").when(long_negative, "long_negative").otherwise(""),
    })


def valid_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("status") == "ok") & (F.col("audit_status") == "valid_both_feet"))


def top_runs(runs: DataFrame, k: int) -> DataFrame:
    """The k runs with most windows, then the highest probability, then reference and start."""
    return runs.orderBy(F.desc("n_windows"), F.desc("max_probability"), "reference", "run_start").limit(k)


def best_per_group(df: DataFrame, *, by: Sequence[str], metric: str, name: str) -> DataFrame:
    """Name and value of the best row of each group; ties go to the smaller name."""
    best = F.min_by(F.struct(F.col(name), F.col(metric)), F.struct(-F.col(metric), F.col(name)))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{name}").alias(name), F.col(f"_b.{metric}").alias(metric))


def joined_labels(df: DataFrame, *, by: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(label)), "|").alias("labels"))


def priority_order(df: DataFrame) -> DataFrame:
    """Best class first, then more common hours, then reference."""
    return df.orderBy(F.asc("reference_class"), F.desc_nulls_last("common_hours"), "reference")


def with_order_index(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("order_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

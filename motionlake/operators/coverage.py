"""Coverage of requests by samples: counts, statuses, inventories, classifications and quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions import times

FEET = ("Left", "Right")
#: Advice for each status of a request.
ADVICE = {
    "no_records": "choose another interval or check the reference",
    "only_some_feet": "only one foot has data; choose another interval",
    "no_common_interval": "feet do not overlap; widen the interval",
    "valid_both_feet": "extract",
    "invalid_range": "start must be before stop",
}


def count_records(found: DataFrame, *, keys: Sequence[str], feet: Sequence[str] = FEET) -> DataFrame:
    """Records of each foot for each request key, and in all."""
    per = [F.count_if(F.col("foot") == f).alias(f"{f.lower()}_records") for f in feet]
    return found.groupBy(*keys).agg(*per, F.count(F.lit(1)).alias("total_records"))


def with_missing(requests: DataFrame, counts: DataFrame, *, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All requests, those without records with zeros."""
    return requests.join(counts, list(keys), "left").fillna(0, list(columns))


def coverage(samples: DataFrame, *, by: Sequence[str], time: str = "_time") -> DataFrame:
    """Rows, first and last time of each foot."""
    return samples.groupBy(*by, "foot").agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"))


def coverage_status(per_foot: DataFrame, *, by: Sequence[str], feet: Sequence[str] = FEET) -> DataFrame:
    """Status and common interval of both feet: from the later first to the earlier last time."""
    get = lambda f, c: F.max(F.when(F.col("foot") == f, F.col(c)))
    wide = per_foot.groupBy(*by).agg(
        F.count_if(F.col("foot").isin(*feet) & (F.col("n_rows") > 0)).alias("n_feet"),
        F.greatest(*(get(f, "first") for f in feet)).alias("common_start"),
        F.least(*(get(f, "last") for f in feet)).alias("common_stop"),
        F.sum("n_rows").alias("total_rows"),
    )
    status = F.when(F.col("n_feet") == 0, "no_records").when(F.col("n_feet") < len(feet), "only_some_feet").when(F.col("common_start") >= F.col("common_stop"), "no_common_interval").otherwise("valid_both_feet")
    both = F.col("n_feet") == len(feet)
    return wide.withColumns({"status": status, "common_start": F.when(both, F.col("common_start")), "common_stop": F.when(both, F.col("common_stop"))})


def block_status(counts: DataFrame, least: int, feet: Sequence[str] = FEET) -> DataFrame:
    """no_records, only_some, low_records or valid, with the smallest foot."""
    columns = [F.col(f"{f.lower()}_records") for f in feet]
    low, high = F.least(*columns), F.greatest(*columns)
    status = F.when(high == 0, "no_records").when(low == 0, "only_some").when(low < least, "low_records").otherwise("valid")
    return counts.withColumns({"min_records_per_foot": low, "status": status})


def inventory(samples: DataFrame, feet: Sequence[str] = FEET, time: str = "_time") -> DataFrame:
    """For each reference: counts, first and last of each foot, total, validity, hours of the intersection."""
    per = coverage(samples, by=["reference"], time=time)
    get = lambda f, c: F.max(F.when(F.col("foot") == f, F.col(c)))
    made = []
    for f in feet:
        made += [F.coalesce(get(f, "n_rows"), F.lit(0)).alias(f"{f.lower()}_rows"), get(f, "first").alias(f"{f.lower()}_first"), get(f, "last").alias(f"{f.lower()}_last")]
    wide = per.groupBy("reference").agg(*made)
    low, high = F.greatest(*(F.col(f"{f.lower()}_first") for f in feet)), F.least(*(F.col(f"{f.lower()}_last") for f in feet))
    valid = F.lit(True)
    for f in feet:
        valid = valid & (F.col(f"{f.lower()}_rows") > 0)
    hours = F.when(valid & (low < high), (times.micros(high) - times.micros(low)) / (3600 * times.SECOND)).otherwise(0.0)
    return wide.withColumns({"total_rows": sum((F.col(f"{f.lower()}_rows") for f in feet), F.lit(0)), "valid_both_feet": valid, "common_hours": hours})


def label_summary(labels: DataFrame, classes: Sequence[str] = ("walking", "not_walking")) -> DataFrame:
    """Intervals and seconds of each class for each reference, whether both occur, first and last."""
    s = times.seconds_between("start", "stop")
    made = []
    for c in classes:
        own = F.col("label") == c
        made += [F.count_if(own).alias(f"intervals_{c}"), F.coalesce(F.sum(F.when(own, s)), F.lit(0.0)).alias(f"seconds_{c}")]
    found = labels.groupBy("reference").agg(*made, F.min("start").alias("first_start"), F.max("stop").alias("last_stop"))
    both = F.lit(True)
    for c in classes:
        both = both & (F.col(f"intervals_{c}") > 0)
    return found.withColumn("has_both", both)


def candidate_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("reference").agg(F.min("priority").alias("best_priority"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"), F.count(F.lit(1)).alias("n_candidates"))


def enrich(inventory_: DataFrame, labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """The inventory with what is known of labels and candidates; what is missing is zero or false."""
    l = labels.select("reference", "intervals_walking", "intervals_not_walking", "has_both")  # noqa: E741
    c = candidates.select("reference", "best_priority", "n_candidates")
    rows = inventory_.join(l, "reference", "left").join(c, "reference", "left")
    return rows.fillna(0, ["intervals_walking", "intervals_not_walking", "n_candidates"]).fillna(False, ["has_both"])


def reference_class() -> Column:
    """Six classes by data and labels."""
    labelled = (F.col("intervals_walking") + F.col("intervals_not_walking")) > 0
    return (
        F.when(F.col("total_rows") == 0, "no_data")
        .when(~F.col("valid_both_feet"), "one_foot_only")
        .when(F.col("has_both"), "labelled_both_classes")
        .when(labelled, "labelled_one_class")
        .when(F.col("n_candidates") > 0, "candidate_to_label")
        .otherwise("unlabelled")
    )


def reference_action() -> Column:
    """What to do with each class."""
    return (
        F.when(F.col("reference_class") == "no_data", "ignore")
        .when(F.col("reference_class") == "one_foot_only", "check the sensor")
        .when(F.col("reference_class") == "labelled_both_classes", "use for training")
        .when(F.col("reference_class") == "labelled_one_class", "label the other class")
        .when(F.col("reference_class") == "candidate_to_label", "label candidates")
        .otherwise("find candidate intervals")
    )


def classify_references(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("reference_class", reference_class()).withColumn("action", reference_action())


def candidate_kind(summary: DataFrame) -> DataFrame:
    """Kind and priority of a reference as a source of further labels."""
    kind = F.when(F.col("has_both"), "both_classes").when(F.col("intervals_not_walking") > 0, "only_not_walking").when(F.col("intervals_walking") > 0, "only_walking").otherwise("no_labels")
    priority = F.when(F.col("candidate_kind") == "both_classes", 1).when(F.col("candidate_kind") == "only_not_walking", 2).when(F.col("candidate_kind") == "only_walking", 3).otherwise(4)
    return summary.withColumn("candidate_kind", kind).withColumn("candidate_priority", priority)


def quota_scan(blocks: DataFrame, *, by: Sequence[str], order: Sequence[str], valid: Column, most_valid: int, most_scanned: int) -> DataFrame:
    """Blocks that a scan in order would look at: until most_valid valid ones are found, most_scanned at most."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(valid.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumns({"scan_rank": F.row_number().over(w), "valid_before": before}).where((F.col("scan_rank") <= most_scanned) & (F.col("valid_before") < most_valid))


def up_to_first_success(tries: DataFrame, *, by: Sequence[str], order: Sequence[str], ok: Column) -> DataFrame:
    """Tries in order up to the first that succeeds, and whether each one did."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tries.withColumns({"try_rank": F.row_number().over(w), "_before": before, "succeeded": ok}).where("_before = 0").drop("_before")


def diagnose(requests: DataFrame, samples_in: DataFrame, *, key: str) -> DataFrame:
    """Status, common interval and advice of each request, before anything is extracted."""
    status = coverage_status(coverage(samples_in, by=[key]), by=[key])
    rows = requests.join(status, key, "left")
    final = F.when(F.col("start") >= F.col("stop"), "invalid_range").otherwise(F.coalesce("status", F.lit("no_records")))
    rows = rows.withColumn("status", final).fillna(0, ["n_feet", "total_rows"])
    advice = F.lit(None).cast("string")
    for name, text in ADVICE.items():
        advice = F.when(F.col("status") == name, text).otherwise(advice)
    return rows.withColumn("advice", advice)

"""Label corrections by the consensus of models and by the signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions import labels as lab
from motionlake.functions import times
from motionlake.operators.intervals import in_buckets


def consensus(predictions: DataFrame, *, keys: Sequence[str], target: str = "target", vote: str = "prediction", probability: str = "probability", model: str = "model") -> DataFrame:
    """Models, votes and probabilities of each window."""
    return predictions.groupBy(*keys).agg(
        F.min(target).alias("target"),
        F.countDistinct(model).alias("n_models"),
        F.sum(vote).alias("votes"),
        F.min(probability).alias("min_probability"),
        F.avg(probability).alias("mean_probability"),
        F.max(probability).alias("max_probability"),
    )


def propose(windows: DataFrame, *, high: float, low: float) -> DataFrame:
    """Windows to flip: to 1 if all models agree with at least `high`, to 0 if none votes and none exceeds `low`."""
    up = (F.col("target") == 0) & (F.col("votes") == F.col("n_models")) & (F.col("min_probability") >= high)
    down = (F.col("target") == 1) & (F.col("votes") == 0) & (F.col("max_probability") <= low)
    return windows.withColumn("proposed", F.when(up, 1).when(down, 0)).where("proposed is not null")


def apply(dataset: DataFrame, corrections: DataFrame, *, keys: Sequence[str], target: str = "target", label: str = "mov_type") -> DataFrame:
    """The dataset with corrected targets and labels, and whether a row changed. A key corrected twice stops the job."""
    one = corrections.groupBy(*keys).agg(F.max("proposed").alias("_new"), F.count(F.lit(1)).alias("_n"))
    check = F.assert_true(F.col("_n") == 1, F.lit("a key is corrected twice"))
    one = one.select(*keys, F.when(check.isNull(), F.col("_new")).alias("_new"))
    rows = dataset.join(one, list(keys), "left")
    kind = dataset.schema[target].dataType
    return rows.withColumns({target: F.coalesce("_new", target).cast(kind), label: F.when(F.col("_new").isNotNull(), lab.label_of(F.col("_new"))).otherwise(F.col(label)), "corrected": F.col("_new").isNotNull()}).drop("_new")


def signal_review(intervals: DataFrame, samples: DataFrame, *, key: str, value: str, pad_s: float = 0.0, time: str = "_time", by: str = "reference", width_us: int = 86_400 * times.SECOND) -> DataFrame:
    """For each interval: mean over feet of sample deviation and interquartile range of the signal within it, padded."""
    pad = int(pad_s * times.SECOND)
    wide = intervals.select(key, by, times.from_micros(times.micros("start") - pad).alias("_from"), times.from_micros(times.micros("stop") + pad).alias("_to"))
    dealt = in_buckets(wide, "_from", "_to", width_us)
    timed = samples.withColumn("_bucket", F.floor(times.micros(time) / width_us).cast("long"))
    met = timed.join(dealt, [by, "_bucket"]).where((F.col(time) >= F.col("_from")) & (F.col(time) <= F.col("_to")))
    feet = met.groupBy(key, "foot").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("std"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"))
    found = feet.groupBy(key).agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_feet"), F.avg("std").alias("mean_std"), F.avg("iqr").alias("mean_iqr"))
    return intervals.join(found, key, "left").fillna(0, ["n_samples", "n_feet"])


def decide(reviewed: DataFrame, *, moving: float, still: float, proposed: str = "proposed") -> DataFrame:
    """confirm if the signal fits the proposed label, reject if it contradicts it, else review."""
    s, p = F.col("mean_std"), F.col(proposed)
    decision = (
        F.when(s.isNull() | (F.col("n_feet") == 0), "review")
        .when((p == 1) & (s >= moving), "confirm")
        .when((p == 1) & (s <= still), "reject")
        .when((p == 0) & (s <= still), "confirm")
        .when((p == 0) & (s >= moving), "reject")
        .otherwise("review")
    )
    return reviewed.withColumn("decision", decision)


def review_reason(df: DataFrame, first: str, second: str, truth: str, *, margin: float = 0.2) -> DataFrame:
    """Outcome tags of two models, their probability difference and why a window deserves a look."""
    a, b = F.col(f"{first}_prediction"), F.col(f"{second}_prediction")
    tags = {f"{m}_outcome": lab.outcome(F.col(truth), F.col(f"{m}_prediction")) for m in (first, second)}
    delta = F.col(f"{second}_probability") - F.col(f"{first}_probability")
    reason = (
        F.when(F.col(truth).isNull(), "no_truth")
        .when((a == b) & (a != F.col(truth)), "both_wrong")
        .when((a == F.col(truth)) & (b != F.col(truth)), f"{second}_wrong")
        .when((a != F.col(truth)) & (b == F.col(truth)), f"{first}_wrong")
        .when(F.abs(delta) >= margin, "probabilities_differ")
        .otherwise("none")
    )
    return df.withColumns({**tags, "probability_delta": delta, "review_reason": reason})

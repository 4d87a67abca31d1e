"""Labels and targets: normal forms, encodings and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WALKING, NOT_WALKING, NO_LABEL = "walking", "not_walking", "NO_LABEL"
#: Accepted spellings of the two labels.
SYNONYMS = {
    WALKING: ("walking", "walk", "caminar", "andar", "marcha", "1"),
    NOT_WALKING: ("not_walking", "not walking", "no_walking", "notwalking", "standing", "rest", "no caminar", "0"),
}


def normalized(label: Column) -> Column:
    """The label, null if blank, or `invalid:` and the text."""
    text = F.trim(F.lower(label.cast("string")))
    out = F.when(text == "", F.lit(None).cast("string"))
    for name, forms in SYNONYMS.items():
        out = out.when(text.isin(*forms), name)
    return out.when(text.isNotNull(), F.concat(F.lit("invalid:"), text))


def target(label: Column) -> Column:
    return F.when(label == WALKING, 1).when(label == NOT_WALKING, 0).cast("tinyint")


def label_of(value: Column) -> Column:
    return F.when(value == 1, WALKING).when(value == 0, NOT_WALKING)


def with_target(df: DataFrame, label: str = "mov_type", column: str = "target") -> DataFrame:
    """Keep the target that is there, else derive it from the label."""
    made = target(F.col(label))
    return df.withColumn(column, F.coalesce(F.col(column).cast("tinyint"), made) if column in df.columns else made)


def predicted(probability: Column, threshold: float) -> Column:
    return F.when(probability >= threshold, 1).otherwise(0)


def fallback(label: Column, other: Column | str) -> Column:
    """The label if it is one of the two, else the other."""
    return F.when(label.isin(WALKING, NOT_WALKING), label).otherwise(F.lit(other) if isinstance(other, str) else other)


def outcome(truth: Column, prediction: Column) -> Column:
    return F.when((truth == 1) & (prediction == 1), "TP").when((truth == 0) & (prediction == 1), "FP").when((truth == 1) & (prediction == 0), "FN").when((truth == 0) & (prediction == 0), "TN")


def error_mask(truth: Column, prediction: Column, kind: str = "both") -> Column:
    """Whether a row is a false positive (`fp`), a false negative (`fn`) or either."""
    positive, negative = (truth == 0) & (prediction == 1), (truth == 1) & (prediction == 0)
    return {"fp": positive, "fn": negative, "both": positive | negative}[kind]

"""Column names and contracts of tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself, or an error that names what is missing. No job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_same_schema(left: DataFrame, right: DataFrame) -> None:
    kinds = [{f.name: f.dataType.simpleString() for f in x.schema.fields} for x in (left, right)]
    if kinds[0] != kinds[1]:
        odd = sorted(set(kinds[0].items()) ^ set(kinds[1].items()))
        raise ValueError(f"schemas differ: {odd}")


def first_existing(df: DataFrame, names: Sequence[str]) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(names)}")


def aliased(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the first existing candidate of each name to that name."""
    found = {first_existing(df, names): to for to, names in aliases.items()}
    return df.withColumnsRenamed({a: b for a, b in found.items() if a != b})


def violations(df: DataFrame, target: str = "target", label: str = "mov_type") -> DataFrame:
    """One row: rows whose target contradicts the label, whose target is null, and rows in all."""
    expected = F.when(F.col(label) == "walking", 1).when(F.col(label) == "not_walking", 0)
    return df.agg(F.count_if(~F.col(target).eqNullSafe(expected)).alias("contradictions"), F.count_if(F.col(target).isNull()).alias("null_targets"), F.count(F.lit(1)).alias("n_rows"))


def numeric_features(df: DataFrame, ids: Iterable[str]) -> list[str]:
    """Numeric columns that are no ids, in order."""
    ids = set(ids)
    return [f.name for f in df.schema.fields if f.name not in ids and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with a check, made while it runs: a repeated key stops the job."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
    check = F.assert_true(F.col("_most") <= 1, F.lit(f"repeated key {', '.join(keys)}"))
    return df.crossJoin(F.broadcast(repeated.select(check.alias("_ok")))).where("_ok is null").drop("_ok")  # one row

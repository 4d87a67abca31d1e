"""Sensor points: scans, pivots, raw extracts, files and resumption.

A point table has one row for each value: reference, foot, _time, field, value. Requests are rows
(reference, start, stop); many requests are answered by one job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.functions import times
from motionlake.functions.contracts import require_columns
from motionlake.functions.labels import NOT_WALKING, WALKING

SIGNALS = ("Ax", "Ay", "Az", "Gx", "Gy", "Gz")


def scan_points(points: DataFrame, requests: DataFrame, *, fields: Sequence[str], feet: Sequence[str] | None = None) -> DataFrame:
    """Points of the requested half-open ranges, with all columns of the request but its reference.

    The field and foot filters reach the file scan. A request is joined by reference and day, so that a long
    range meets only the days that it covers.
    """
    rows = points.where(F.col("field").isin(*fields))
    if feet:
        rows = rows.where(F.col("foot").isin(*feet))
    rows = rows.withColumn("_day", F.to_date("_time"))
    days = F.explode(F.sequence(F.to_date("start"), F.to_date("stop"))).alias("_day")
    wanted = requests.where("start < stop").select("*", days)
    return rows.join(wanted, ["reference", "_day"]).where((F.col("_time") >= F.col("start")) & (F.col("_time") < F.col("stop"))).drop("_day")


def pivot_fields(points: DataFrame, fields: Sequence[str], *, keys: Sequence[str] = ("reference", "foot", "_time")) -> DataFrame:
    """One row for each key, a column for each field. Of repeated points the smallest value stays, so that runs agree."""
    return points.groupBy(*keys).agg(*(F.min(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def normalize_samples(wide: DataFrame, signals: Sequence[str] = SIGNALS, tie: str | None = None) -> DataFrame:
    """Known signals only, times as timestamps, one row for each (reference, foot, _time): the least by `tie`."""
    own = [s for s in signals if s in wide.columns]
    order = F.col(tie) if tie else F.struct(*own)
    rows = wide.withColumn("_time", F.to_timestamp("_time")).where("_time is not null")
    return rows.groupBy("reference", "foot", "_time").agg(F.min_by(F.struct(*own), order).alias("_s")).select("reference", "foot", "_time", *(F.col(f"_s.{s}").alias(s) for s in own))


def raw_extract(points: DataFrame, requests: DataFrame, *, fields: Sequence[str], zone: str = "UTC") -> DataFrame:
    """Wide samples of both feet with the bounds of their request, local and UTC, as text."""
    found = scan_points(points, requests, fields=fields)
    wide = pivot_fields(found, fields, keys=("reference", "foot", "start", "stop", "_time"))
    form = "yyyy-MM-dd HH:mm:ss"
    return wide.select(
        "reference",
        "foot",
        "_time",
        *fields,
        F.date_format(times.to_local(F.to_timestamp("start"), zone), form).alias("from_local"),
        F.date_format(times.to_local(F.to_timestamp("stop"), zone), form).alias("until_local"),
        F.lit(zone).alias("timezone"),
        times.rfc3339(F.to_timestamp("start")).alias("from_utc"),
        times.rfc3339(F.to_timestamp("stop")).alias("until_utc"),
    )


def read_parquet(spark: SparkSession, paths: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    found = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return found.select(*columns) if columns else found


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by an explicit schema; text that doesn't fit its type becomes null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def load_labels(tables: DataFrame, zone: str | None = None, *, columns: Sequence[str] = ("reference", "datefrom", "dateuntil", "mov_type")) -> DataFrame:
    """reference, start, stop, label, source_file: the label rows of one table or of files read together.

    Labels are trimmed, and only known ones stay; bounds are texts of mixed forms (local time of `zone`, else UTC) or
    timestamps; source_file stays if it is there. Rows with an unreadable bound stay with a null.
    """
    require_columns(tables, columns)
    reference, start, stop, label = columns
    bound = lambda c: times.parse_mixed(F.col(c), zone) if tables.schema[c].dataType.typeName() == "string" else F.col(c)
    more = ["source_file"] if "source_file" in tables.columns else []
    rows = tables.select(F.col(reference).cast("string").alias("reference"), bound(start).alias("start"), bound(stop).alias("stop"), F.trim(label).alias("label"), *more)
    return rows.where(F.col("label").isin(WALKING, NOT_WALKING))


def read_labels(spark: SparkSession, paths: list[str], zone: str | None = None) -> DataFrame:
    """load_labels of CSV files, in order of reference and time, with the file of each row."""
    found = spark.read.csv(paths, header=True, schema="reference string, datefrom string, dateuntil string, mov_type string")
    return load_labels(found.select("*", F.col("_metadata.file_name").alias("source_file")), zone).orderBy("reference", "start", "stop")


def read_files(spark: SparkSession, paths: list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Several parquet files as one table, with the file of each row."""
    found = spark.read.parquet(*paths)
    return found.select(*(columns or found.columns), F.col("_metadata.file_path").alias("source_file"))


def bundle_rows(files: DataFrame, *, reference: str) -> DataFrame:
    """Rows of single-signal CSV files from a table (source_file, content): time and value, in file order.

    The foot comes from the file name and the signal from the header's first word after the comma. A byte-order
    mark is dropped; text that is no number gives a null value.
    """
    lines = F.split(F.regexp_replace("content", "^﻿", ""), r"\r?\n")
    header = F.split(F.get(lines, F.lit(0)), ",")
    name = F.lower("source_file")
    rows = files.select(
        "source_file",
        F.when(name.contains("right"), "Right").when(name.contains("left"), "Left").alias("foot"),
        F.trim(F.get(header, F.lit(1))).alias("raw_channel_name"),
        F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("sample_order", "line"),
    )
    cells = F.split("line", ",")
    return rows.where(F.trim("line") != "").select(
        F.lit(reference).alias("reference"),
        "foot",
        F.split("raw_channel_name", " ")[0].alias("signal"),
        "raw_channel_name",
        "source_file",
        F.col("sample_order").cast("long").alias("sample_order"),
        F.trim(F.get(cells, F.lit(0))).alias("time"),
        F.expr("try_cast(trim(get(split(line, ','), 1)) as double)").alias("value"),
    )


def import_bundle(spark: SparkSession, path: str, *, reference: str) -> DataFrame:
    """The CSV files below a path as bundle rows. A file is one sensor channel and is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))
    return bundle_rows(files, reference=reference)


def bundle_manifest(rows: DataFrame, keys: Iterable[str] = ("source_file", "foot", "signal"), time: str = "time") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(time).alias("distinct_times"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def pending(requests: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests whose key has no output yet."""
    return requests.join(done.select(*keys).distinct(), list(keys), "left_anti")


def audit_statuses(spark: SparkSession, path: str) -> DataFrame:
    """file, status and row total of audit records: counters if there are any, else the sum over feet."""
    schema = "status string, counters struct<rows:long>, feet map<string, struct<rows:long>>"
    found = spark.read.schema(schema).json(path)
    per_foot = F.aggregate(F.map_values("feet"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["rows"], F.lit(0)))
    return found.select(F.col("_metadata.file_name").alias("file"), "status", F.coalesce("counters.rows", per_foot, F.lit(0)).alias("n_rows"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its
    own; a cluster has none that could be guessed, and the job stops."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one job, so that each can be deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *gone: DataFrame) -> None:
        """Delete these tables; whoever reads them later fails."""
        for table, path in self.tables:
            if any(table is x for x in gone):
                delete(self.spark, path)
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in gone)]

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*(t for t, _ in self.tables if not any(t is x for x in kept)))


def within(df: DataFrame, rows: int, size: int = 64_000_000) -> bool:
    """Whether df has at most this many rows and about this many bytes: texts count with their length, arrays with
    eight bytes an entry, anything else with eight bytes. Both are counted over all rows, in as many tasks as df has."""
    parts = [F.lit(0)]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        parts.append(F.octet_length(f.name) if kind in ("string", "binary") else 8 * F.size(f.name) if kind == "array" else F.lit(8))
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), parts[0]).cast("long")).alias("size")).first()
    return total.n <= rows and (total.size or 0) <= size


def broadcast_within(df: DataFrame, rows: int, size: int = 64_000_000) -> DataFrame:
    """df with a broadcast hint if it is within these bounds; otherwise unchanged, so that Spark shuffles."""
    return F.broadcast(df) if within(df, rows, size) else df


def release() -> None:
    """Give freed memory back to the system. Python workers live on between stages, beside the executor's own memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library keeps freed pages
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow whose tasks leave no memory behind."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def require_integer(df: DataFrame, column: str) -> None:
    """An error if the column holds no integers; no job runs."""
    kind = df.schema[column].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{column} must be an integer column, not {kind}")


def holdout(column: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int, among: int | None = None) -> DataFrame:
    """About `rows` rows (at most), chosen by a hash of the key, the same at every run.

    `among` is the number of rows of df if the caller knows it. Used only to fit models, never to
    choose which rows a result covers.
    """
    total = df.count() if among is None else among
    if total > rows:
        share = min(1.0, 1.1 * rows / total)
        df = df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return df.limit(rows)

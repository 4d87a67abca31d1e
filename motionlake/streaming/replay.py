"""A stored table fed to a streaming query in time order.

Files of a table may come in any order. A stream that reads them as they come either loses rows behind its watermark
or holds every window until the end. Here the table is first dealt into slices of time, one shuffle-free write, and
each slice is one micro-batch: no row is ever late with a watermark of no delay, and state holds no more than the
windows of one slice and those still open at its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: The watermark that goes with slices in time order.
NO_DELAY = "0 seconds"


def folder_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the files of a folder, which is made if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.readStream.schema(schema).parquet(path)


def append(out: DataFrame, path: str) -> int:
    """Run a stream over what its source holds beyond the checkpoint; the rows it then keeps in state."""
    run = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    return _held(run)


def update(out: DataFrame, path: str) -> int:
    """As `append`, in update mode: one folder for each micro-batch, so that a repeated batch replaces its own rows."""
    run = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/rows/batch={i}")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    return _held(run)


def _held(run) -> int:
    run.awaitTermination()
    last = run.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0


def slice_number(rows: DataFrame, time: str, slices: int) -> Column:
    """The slice of a row: at most `slices` of about equal size. Equal times share a slice; rows without a time are in the last one."""
    us = F.unix_micros(time)
    cuts = rows.agg(F.percentile_approx(us, [i / slices for i in range(1, slices)], 10_000)).collect()[0][0] if slices > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    return F.when(us.isNull(), len(cuts)).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= us)))


def in_time_order(rows: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, *, time: str = "_time", slices: int, closing: DataFrame | None = None, run: Callable[[DataFrame, str], int] = append) -> tuple[DataFrame, list[int]]:
    """What the stream `make(rows)` puts out, and the rows in its state after each slice.

    path: an unused folder that all executors share. closing: rows of the same columns that come after all slices, to
    close what is open. slices: at most this many micro-batches (1 to 256); it bounds state, and changes no result. An
    empty table gives an empty result. Killed runs are repeated with a new path.
    """
    if not 1 <= slices <= 256:
        raise ValueError("slices: 1 to 256")
    spark = rows.sparkSession
    rows.withColumn("_slice", slice_number(rows, time, slices)).write.partitionBy("_slice").parquet(f"{path}/slices")
    schema = rows.schema
    dealt = spark.read.schema(StructType([*schema.fields]).add("_slice", IntegerType())).parquet(f"{path}/slices")
    out, held = make(folder_stream(spark, f"{path}/in", schema)), []
    numbers = [r[0] for r in dealt.select("_slice").distinct().orderBy("_slice").collect()]  # at most `slices`
    for part in [*(dealt.where(F.col("_slice") == i).drop("_slice") for i in numbers), *([closing] if closing is not None else [])]:
        part.write.mode("append").parquet(f"{path}/in")
        held.append(run(out, path))
    if not held:
        return spark.createDataFrame([], out.schema), held
    return spark.read.schema(out.schema).parquet(f"{path}/rows").select(*out.columns), held

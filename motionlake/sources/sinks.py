"""Sinks: appended tables, files by extension, a folder for each reference, audit records."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, the folder that driver and executors share. Where it is unset, a local
    session gets a folder of its own; on a cluster the job stops."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once below the shared folder and read back, for jobs that pass over it many times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, by: str = "reference") -> None:
    """Append to a table partitioned by reference; a repeated run of the same references goes through `replace`."""
    df.write.mode("append").partitionBy(by).parquet(path)


def replace(df: DataFrame, path: str, by: str = "reference") -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _manifests(spark: SparkSession, path: str) -> tuple[object, list[str]]:
    """The file system of a table of chunks, and its manifests in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*.json"))
    return files, sorted(str(x.getPath().toString()) for x in found or [])


def committed_chunks(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each chunk that the last manifest lists."""
    _, found = _manifests(spark, path)
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0]) if found else {}


def append_chunk(df: DataFrame, path: str, chunk: str) -> None:
    """Append a named chunk to the table at `path`, as often as wanted: a chunk that is there already is replaced.

    The rows go to a folder of their own. Only then a new manifest, the list of all chunks and their folders, is written
    beside the old one and takes the next number by a rename, which either happens or does not. Readers follow the last
    manifest: a write that was killed leaves a folder that nothing lists, and repeating it neither doubles nor loses rows.
    Of two writers at once the later one fails at the rename and has to repeat. An empty chunk is listed, too.
    """
    spark = df.sparkSession
    known, folder = committed_chunks(spark, path), f"chunks/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    files, found = _manifests(spark, path)
    number = int(re.search(r"manifest-(\d+)\.json$", found[-1])[1]) + 1 if found else 0
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = jvm(f"{path}/draft-{uuid.uuid4().hex}"), jvm(f"{path}/manifest-{number:08d}.json")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(known | {chunk: folder}, sort_keys=True).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another writer has committed to {path}; repeat the append")


def read_chunks(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """All committed rows. A table without chunks needs a schema."""
    folders = [f"{path}/{x}" for x in committed_chunks(spark, path).values()]
    if not folders:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)


def remove_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete folders that the last manifest does not list, and older manifests; no writer may be at work. Returns how many
    folders went."""
    files, found = _manifests(spark, path)
    jvm, kept = spark._jvm.org.apache.hadoop.fs.Path, {x.rsplit("/", 1)[-1] for x in committed_chunks(spark, path).values()}
    gone = [x.getPath() for x in files.globStatus(jvm(f"{path}/chunks/*")) or [] if x.getPath().getName() not in kept]
    for old in [*gone, *(jvm(x) for x in found[:-1])]:
        files.delete(old, True)
    return len(gone)


def save(df: DataFrame, path: str) -> None:
    """Parquet or CSV, as the path ends."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")


def save_each(df: DataFrame, path: str, by: str = "reference", rows: int = 5_000_000) -> None:
    """CSV files in a folder for each reference, about `rows` rows a file.

    Rows of a reference come together first, so that it has one file and not one for each task that met it. Making files
    is what takes time here, so there are as many tasks as a shuffle has, however small the rows. A reference of more rows
    is dealt out to several tasks.
    """
    large = df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_files")).where("_files > 1")
    each = df.join(large, df[by].eqNullSafe(F.col("_by")), "left")
    part = F.when(F.col("_files") > 1, F.pmod(F.xxhash64(*df.columns), F.col("_files"))).otherwise(0)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    each.repartition(tasks, by, part).select(*df.columns).write.mode("overwrite").partitionBy(by).csv(path, header=True)


def save_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Files that follow one order, without a single writer."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def audit_record(samples: DataFrame, status: str) -> DataFrame:
    """One row: status, row counter, and for each foot its rows, first and last time."""
    feet = samples.groupBy("foot").agg(F.count(F.lit(1)).alias("rows"), F.min("_time").alias("first"), F.max("_time").alias("last"))
    per_foot = F.map_from_entries(F.sort_array(F.collect_list(F.struct("foot", F.struct("rows", "first", "last"))))).alias("feet")
    return feet.agg(F.lit(status).alias("status"), F.struct(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).alias("counters"), per_foot)


def save_audit(samples: DataFrame, path: str, status: str = "ok") -> None:
    audit_record(samples, status).write.mode("append").json(path)

"""Registration of queries and the stand-ins that play the sensor tables on the given data."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Digits of floating-point results, here and in the SQL.
DIGITS = 6


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Register a function (spark, sf_dir). Its doubles are rounded and its timestamps lose their zone; the SQL's
    columns named in `doubles` are rounded alike."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            made = {}
            for field in df.schema.fields:
                kind = field.dataType.typeName()
                if kind in ("double", "float"):
                    made[field.name] = F.round(F.col(field.name), DIGITS)
                elif kind == "timestamp":
                    made[field.name] = F.col(field.name).cast("timestamp_ntz")
            return df.withColumns(made) if made else df

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            rounded = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in doubles.split())
            SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if rounded else sql
        return f

    return wrap


#: Settings that the registered queries need.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_own: WeakKeyDictionary[SparkSession, SparkSession] = WeakKeyDictionary()


def session(spark: SparkSession) -> SparkSession:
    """The session itself if its settings are those that the queries need, else one beside it: the caller's stays as it is."""
    if all(spark.conf.get(k, None) == v for k, v in SETTINGS.items()):
        return spark
    if spark not in _own:
        _own[spark] = spark.newSession()
        for k, v in SETTINGS.items():
            _own[spark].conf.set(k, v)
    return _own[spark]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less timestamps are UTC."""
    spark = session(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"} or {df.columns[0]: F.col(df.columns[0])})


def foot(column: str = "event_type") -> Column:
    return F.when(F.col(column) == "view", "Left").when(F.col(column) == "click", "Right")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, reference, foot, event_type, _time, value: users play references, event types fields and feet."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("reference"), foot().alias("foot"), "event_type", F.col("ts").alias("_time"), "value")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, reference, start, stop, label: each signup opens a day; the label follows its value."""
    e = events(spark, sf_dir).where("event_type = 'signup'")
    stop = F.col("_time") + F.expr("INTERVAL 1 DAY")
    return e.select(F.col("event_id").alias("label_id"), "reference", F.col("_time").alias("start"), stop.alias("stop"), F.when(F.col("value") > 100, "walking").otherwise("not_walking").alias("label"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reference, start, stop: each error closes six hours."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select("reference", F.col("_time").alias("start"), (F.col("_time") + F.expr("INTERVAL 6 HOURS")).alias("stop"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, reference, _time, probability, target."""
    e = events(spark, sf_dir)
    return e.select("event_id", "reference", "_time", F.least(F.col("value") / 200, F.lit(1.0)).alias("probability"), (F.col("event_id") % 2).cast("int").alias("target"))


#: The same stand-ins in SQL, to be put after WITH.
EV = "ev AS (SELECT event_id, user_id AS reference, CASE event_type WHEN 'view' THEN 'Left' WHEN 'click' THEN 'Right' END AS foot, event_type, ts AS _time, value FROM events)"
LB = EV + ", lb AS (SELECT event_id AS label_id, reference, _time AS start, _time + INTERVAL 1 DAY AS stop, CASE WHEN value > 100 THEN 'walking' ELSE 'not_walking' END AS label FROM ev WHERE event_type = 'signup')"
EX = EV + ", ex AS (SELECT reference, _time AS start, _time + INTERVAL 6 HOUR AS stop FROM ev WHERE event_type = 'error')"
PR = EV + ", pr AS (SELECT event_id, reference, _time, least(value / 200, 1.0) AS probability, CAST(event_id % 2 AS INTEGER) AS target FROM ev)"

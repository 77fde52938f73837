"""The contract tables expressed on the driver's Parquet tables.

telemetry   <- events grouped by (user_id, hour): max, min, count, max - min of value
machines    <- customer: c_custkey, c_mktsegment, c_nationkey
errors      <- events of type 'error':    errorID = 'error' || (1 + event_id % 5)
failures    <- events of type 'purchase': failure = 'comp'  || (1 + event_id % 4)
maintenance <- events of type 'signup':   comp    = 'comp'  || (1 + event_id % 4)

Every frame is lazy; the event-type filters and the column choice reach the
Parquet scan (``PushedFilters`` / ``ReadSchema``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend.functions.columns import hour_floor

# Event types and category rules of the stand-in tables.
ERROR_EVENT = "error"
FAILURE_EVENT = "purchase"
MAINTENANCE_EVENT = "signup"
ERROR_KINDS = 5
COMPONENT_KINDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read lazily from ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sensor_aggs() -> list:
    """Aggregates of an hour of events that stand for the four sensor columns."""
    return [F.max("value").alias("volt"), F.min("value").alias("rotate"),
            F.count(F.lit(1)).cast("double").alias("pressure"),
            (F.max("value") - F.min("value")).alias("vibration")]


def category(kind: str):
    """The category column an event of ``kind`` ('errors', 'failures', 'maintenance') stands for."""
    label, kinds = ("error", ERROR_KINDS) if kind == "errors" else ("comp", COMPONENT_KINDS)
    return F.concat(F.lit(label), (F.lit(1) + F.col("event_id") % kinds).cast("string"))


EVENT_TYPE_OF = {"errors": ERROR_EVENT, "failures": FAILURE_EVENT, "maintenance": MAINTENANCE_EVENT}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("machineID"), hour_floor("ts").alias("datetime"))
            .agg(*sensor_aggs())
            .select("datetime", "machineID", "volt", "rotate", "pressure", "vibration"))


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    return cu.select(F.col("c_custkey").alias("machineID"), F.col("c_mktsegment").alias("model"),
                     F.col("c_nationkey").cast("long").alias("age"))


def _events_of(spark: SparkSession, sf_dir: str, kind: str, column: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == F.lit(EVENT_TYPE_OF[kind]))
    return ev.select(hour_floor("ts").alias("datetime"), F.col("user_id").alias("machineID"),
                     category(kind).alias(column))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(spark, sf_dir, "errors", "errorID")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(spark, sf_dir, "failures", "failure")


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(spark, sf_dir, "maintenance", "comp")


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All five contract tables, keyed and ordered like the contract registry."""
    return {"telemetry": telemetry(spark, sf_dir), "errors": errors(spark, sf_dir),
            "failures": failures(spark, sf_dir), "machines": machines(spark, sf_dir),
            "maintenance": maintenance(spark, sf_dir)}

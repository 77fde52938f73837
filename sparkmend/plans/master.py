"""The master table: one row per telemetry row, with machine metadata and event counts.

Plan (all lazy, one action at the sink):

    telemetry ──LEFT JOIN── machines
        └──LEFT JOIN on (machineID, datetime)── event counts
                 event counts = failures ∪ maintenance ∪ errors, grouped once

The three event tables are stacked and aggregated in a single hash aggregate
(partial aggregation before the shuffle), so the merge has two shuffles in all:
telemetry and the partially aggregated events, both on (machineID, datetime).
Telemetry is never sorted for the joins; order is a sink concern.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmend import contracts as C
from sparkmend.functions.columns import zero_fill
from sparkmend.functions.onehot import EventSpec, combined_event_counts, discover_categories
from sparkmend.operators.joins import left_join
from sparkmend.operators.sort import partitions_for


def event_counts(failures: DataFrame, maintenance: DataFrame, errors: DataFrame,
                 discover: bool = False) -> DataFrame:
    """Counts per (machineID, datetime): failure_*, failure flag, maint_*, errorID_*."""
    if discover:
        fc = discover_categories(failures, "failure")
        mc = discover_categories(maintenance, "comp")
        ec = discover_categories(errors, "errorID")
    else:
        fc, mc, ec = C.FAILURE_CATEGORIES, C.MAINTENANCE_CATEGORIES, C.ERROR_CATEGORIES
    specs = [
        EventSpec(failures, "failure", C.FAILURE_PREFIX, tuple(fc), flag=C.TARGET_COLUMN),
        EventSpec(maintenance, "comp", C.MAINTENANCE_PREFIX, tuple(mc)),
        EventSpec(errors, "errorID", C.ERROR_PREFIX, tuple(ec)),
    ]
    return combined_event_counts(specs, C.KEY_COLUMNS)


def merge_master(telemetry: DataFrame, machines: DataFrame, failures: DataFrame,
                 maintenance: DataFrame, errors: DataFrame, discover: bool = False) -> DataFrame:
    """Merge the five typed contract tables into the master table.

    With ``discover=False`` (default) the output schema is the pinned contract:
    one column per declared category, in contract order. With ``discover=True``
    the categories are those present, sorted, as a one-hot encoder would emit.
    """
    counts = event_counts(failures, maintenance, errors, discover)
    count_cols = [c for c in counts.columns if c not in C.KEY_COLUMNS]
    merged = left_join(telemetry, machines, ["machineID"])
    merged = merged.join(counts, on=C.KEY_COLUMNS, how="left")
    merged = zero_fill(merged, count_cols)
    front = list(telemetry.columns) + [c for c in machines.columns if c != "machineID"]
    return merged.select(*front, *count_cols)


def write_master(master: DataFrame, path: str, rows: int | None = None) -> None:
    """Write the master as ``date=`` folders, each one's rows in key order.

    Rows are range-partitioned by (date, machine, hour): a task writes a contiguous range, so the files follow the days and the data size
    (about 256 MiB each when ``rows`` is known), and a hot day or machine spreads over many tasks.
    """
    dated = master.withColumn("date", F.to_date("datetime"))
    keys = ["date", *C.KEY_COLUMNS]
    ranged = dated.repartitionByRange(*keys) if rows is None else dated.repartitionByRange(partitions_for(rows, master), *keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("date").parquet(path)


def read_master(spark: SparkSession, path: str, first: dt.datetime | None = None, last: dt.datetime | None = None) -> DataFrame:
    """Master rows of ``first <= datetime < last`` (both optional); only the date folders of that span are read.

    A master without date folders is read whole and filtered by time.
    """
    from sparkmend.functions.columns import ntz_literal
    rows = spark.read.parquet(path)
    if "date" in rows.columns:
        if first is not None:
            rows = rows.where(F.col("date") >= F.lit(first.date()))
        if last is not None:
            rows = rows.where(F.col("date") <= F.lit(last.date()))
        rows = rows.drop("date")
    if first is not None:
        rows = rows.where(F.col("datetime") >= ntz_literal(first))
    return rows if last is None else rows.where(F.col("datetime") < ntz_literal(last))


def master_from_standins(spark, sf_dir: str, **kw) -> DataFrame:
    """Master table over the driver tables (stand-ins in ``sparkmend.sources.standins``)."""
    from sparkmend.sources import standins as S
    t = S.raw_tables(spark, sf_dir)
    return merge_master(t["telemetry"], t["machines"], t["failures"], t["maintenance"],
                        t["errors"], **kw)


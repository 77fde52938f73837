"""Hot keys: one machine with a third of all rows, a burst of identical events on one key."""

import datetime as dt

from pyspark.sql import functions as F

from sparkmend.functions.onehot import onehot_counts
from sparkmend.plans import features as FT
from sparkmend.plans.master import merge_master


def _skewed_master(spark, hot_hours=6000, machines=60, cold_hours=200):
    base = dt.datetime(2023, 1, 1)
    hot = spark.range(hot_hours).select(
        (F.lit(base) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("datetime"),
        F.lit(0).cast("long").alias("machineID"),
        (F.col("id") % 17).cast("double").alias("volt"),
        F.when(F.col("id") % 500 == 499, 1.0).otherwise(0.0).alias("failure"),
        F.when(F.col("id") % 97 == 0, 1.0).otherwise(0.0).alias("maint_comp1"))
    cold = spark.range(machines * cold_hours).select(
        (F.lit(base) + F.make_dt_interval(F.lit(0), (F.col("id") % cold_hours).cast("int")))
        .cast("timestamp_ntz").alias("datetime"),
        ((F.col("id") / cold_hours).cast("long") + 1).alias("machineID"),
        (F.col("id") % 5).cast("double").alias("volt"),
        F.lit(0.0).alias("failure"), F.lit(0.0).alias("maint_comp1"))
    return hot.unionByName(cold)


def test_hot_machine_is_split_into_bounded_partitions(spark):
    df = _skewed_master(spark)
    n = df.count()
    assert df.where("machineID = 0").count() * 2 >= n // 2  # the hot machine holds about a third+
    out = FT.window_features(df, ["machineID", "datetime"], 168, sensors=["volt"], windows_hours=(24,),
                             lags=(1, 24), history=["maint_comp1"], cumulative=["failure"],
                             label_target="failure", horizon_hours=24)
    assert out.count() == n  # whole results: every row, no caps
    # the largest window partition is one bucket of one machine plus its halos
    rows = FT._bucketed(FT.with_order_column(df), 168, 25, 24)
    biggest = rows.groupBy("machineID", FT.BUCKET_COL).count().agg(F.max("count")).first()[0]
    assert biggest <= 168 + 25 + 24
    # and the split result equals the per-machine evaluation
    ref = FT.window_features(df, ["machineID", "datetime"], None, sensors=["volt"], windows_hours=(24,),
                             lags=(1, 24), history=["maint_comp1"], cumulative=["failure"],
                             label_target="failure", horizon_hours=24)
    diff = out.exceptAll(ref).count() + ref.exceptAll(out).count()
    assert diff == 0


def test_identical_event_burst_collapses_before_the_shuffle(spark):
    burst = spark.range(30000).select(F.lit(7).cast("long").alias("machineID"),
                                      F.lit("2024-01-01 05:00:00").cast("timestamp_ntz").alias("datetime"),
                                      F.lit("comp2").alias("failure"))
    out = onehot_counts(burst, "failure", ["machineID", "datetime"], ["comp1", "comp2"], "failure")
    assert out.collect()[0].failure_comp2 == 30000.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # partial step sits below the shuffle


def test_merge_with_hot_machine(spark):
    df = _skewed_master(spark).select("datetime", "machineID", "volt")
    tel = df.select("datetime", "machineID", "volt", F.lit(1.0).alias("rotate"), F.lit(1.0).alias("pressure"),
                    F.lit(1.0).alias("vibration"))
    mach = spark.range(0, 61).select(F.col("id").alias("machineID"), F.lit("m").alias("model"),
                                     F.lit(3).cast("long").alias("age"))
    ev = df.where("machineID = 0").select("datetime", "machineID", F.lit("comp1").alias("failure"))
    empty_m = ev.limit(0).withColumnRenamed("failure", "comp")
    empty_e = ev.limit(0).withColumnRenamed("failure", "errorID")
    m = merge_master(tel, mach, ev, empty_m, empty_e)
    assert m.count() == tel.count()
    assert m.agg(F.sum("failure_comp1")).first()[0] == ev.count()

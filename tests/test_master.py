"""The master merge: left-join semantics, counts, fill, column order."""

from pyspark.sql import functions as F

from sparkmend import contracts as C
from sparkmend.plans.master import merge_master


def _t(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    if "datetime" in df.columns:
        df = df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    return df


def _tables(spark, failures=None, errors=None):
    tel = _t(spark, [("2015-01-01 06:00:00", 1, 1.0, 2.0, 3.0, 4.0),
                     ("2015-01-01 07:00:00", 1, 1.5, 2.5, 3.5, 4.5),
                     ("2015-01-01 06:00:00", 9, 1.0, 1.0, 1.0, 1.0)],
             "datetime string, machineID long, volt double, rotate double, pressure double, vibration double")
    mach = _t(spark, [(1, "model3", 18)], "machineID long, model string, age long")
    fail = _t(spark, failures if failures is not None else
              [("2015-01-01 06:00:00", 1, "comp2"), ("2015-01-01 06:00:00", 1, "comp2"),
               ("2015-01-01 12:00:00", 1, "comp1")],
              "datetime string, machineID long, failure string")
    maint = _t(spark, [("2015-01-01 07:00:00", 1, "comp4")], "datetime string, machineID long, comp string")
    err = _t(spark, errors if errors is not None else
             [("2015-01-01 06:00:00", 1, "error1"), ("2015-01-01 06:00:00", 1, "error5")],
             "datetime string, machineID long, errorID string")
    return tel, mach, fail, maint, err


def test_master_schema_and_values(spark):
    tel, mach, fail, maint, err = _tables(spark)
    m = merge_master(tel, mach, fail, maint, err)
    assert m.columns == C.MASTER_COLUMNS
    assert m.schema == C.MASTER.schema or [f.dataType for f in m.schema] == \
        [f.dataType for f in C.MASTER.schema]
    rows = {(r.machineID, r.datetime.hour): r for r in m.collect()}
    assert len(rows) == 3  # telemetry rows only: the 12:00 failure has no telemetry row
    r = rows[(1, 6)]
    assert r.failure_comp2 == 2.0 and r.failure == 1.0  # a count, and the 0/1 flag
    assert r.errorID_error1 == 1.0 and r.errorID_error5 == 1.0 and r.maint_comp4 == 0.0
    assert rows[(1, 7)].maint_comp4 == 1.0 and rows[(1, 7)].failure == 0.0
    unmatched = rows[(9, 6)]
    assert unmatched.model is None and unmatched.age is None  # metadata nulls stay
    assert all(unmatched[c] == 0.0 for c in C.EVENT_COLUMNS)  # events are zero-filled


def test_empty_event_tables(spark):
    tel, mach, _, maint, _ = _tables(spark)
    empty_f = _t(spark, [], "datetime string, machineID long, failure string")
    empty_e = _t(spark, [], "datetime string, machineID long, errorID string")
    m = merge_master(tel, mach, empty_f, maint, empty_e)
    assert m.count() == 3
    assert m.agg(F.sum("failure")).first()[0] == 0.0


def test_discovered_mode_uses_present_categories(spark):
    tel, mach, fail, maint, err = _tables(spark)
    m = merge_master(tel, mach, fail, maint, err, discover=True)
    assert [c for c in m.columns if c.startswith("failure_")] == ["failure_comp1", "failure_comp2"]
    assert [c for c in m.columns if c.startswith("errorID_")] == ["errorID_error1", "errorID_error5"]


def test_master_plan_aggregates_events_once(spark):
    tel, mach, fail, maint, err = _tables(spark)
    plan = merge_master(tel, mach, fail, maint, err)._jdf.queryExecution().executedPlan().toString()
    # failures, maintenance and errors are stacked and aggregated by one final aggregate
    assert plan.count("Union") == 1

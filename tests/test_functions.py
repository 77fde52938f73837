"""Column expressions and one-hot counts."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmend.functions import columns as fc
from sparkmend.functions.columns import try_parse_datetime, try_parse_integer
from sparkmend.functions.onehot import (EventSpec, category_counts, combined_event_counts, discover_categories,
                                        onehot_counts)


def test_hour_floor_keeps_wall_clock(spark):
    df = spark.createDataFrame([("2024-03-10 02:59:59.999999",), ("2024-01-01 00:00:00",)], "s string")
    out = df.select(fc.hour_floor(F.col("s").cast("timestamp_ntz")).alias("h")).collect()
    assert [r.h for r in out] == [dt.datetime(2024, 3, 10, 2), dt.datetime(2024, 1, 1, 0)]


def test_parse_datetime_formats_and_errors(spark):
    df = spark.createDataFrame([("2015-01-01 06:00:00",), ("1/1/2015 6:00:00 AM",),
                                ("2015-01-01T07:30:00",), (None,), ("garbage",)], "s string")
    got = [r.t for r in df.select(fc.try_parse_datetime("s").alias("t")).collect()]
    assert got[:3] == [dt.datetime(2015, 1, 1, 6), dt.datetime(2015, 1, 1, 6),
                       dt.datetime(2015, 1, 1, 7, 30)]
    assert got[3] is None and got[4] is None
    with pytest.raises(Exception, match="unparseable datetime"):
        df.select(fc.parse_datetime("s")).collect()
    ok = df.where(F.col("s") != "garbage").select(fc.parse_datetime("s").alias("t")).collect()
    assert len(ok) == 3


def test_horizontal_sum_flag_and_zero_fill(spark):
    df = spark.createDataFrame([(1.0, None, None, None), (None, None, None, "x"), (0.0, 2.0, 1.0, None)],
                               "failure_comp1 double, failure_comp2 double, maint_comp1 double, model string")
    flagged = fc.with_failure_flag(df).collect()
    assert [r.failure for r in flagged] == [1.0, 0.0, 1.0]
    filled = fc.zero_fill(df, ["failure_comp1", "failure_comp2"]).collect()
    assert filled[1].failure_comp1 == 0.0 and filled[1].maint_comp1 is None
    assert filled[0].model is None  # text columns keep their nulls
    assert fc.columns_with_prefix(df, "failure", ("failure",)) == ["failure_comp1", "failure_comp2"]
    assert fc.columns_except(df, ["model"], ("maint_comp1",)) == ["failure_comp1", "failure_comp2"]


def _events(spark):
    rows = [(1, "2015-01-01 06:00:00", "comp1"), (1, "2015-01-01 06:00:00", "comp1"),
            (1, "2015-01-01 06:00:00", "comp2"), (2, "2015-01-01 06:00:00", None),
            (None, "2015-01-01 06:00:00", "comp3"), (3, "2015-01-01 07:00:00", "comp9")]
    return spark.createDataFrame(rows, "machineID long, d string, failure string").select(
        "machineID", F.col("d").cast("timestamp_ntz").alias("datetime"), "failure")


def test_onehot_counts_not_flags(spark):
    out = {r.machineID: r for r in onehot_counts(
        _events(spark), "failure", ["machineID", "datetime"], ["comp1", "comp2", "comp3", "comp4"],
        "failure", flag="failure").collect()}
    assert set(out) == {1, 2, 3}  # the null key is dropped
    assert out[1].failure_comp1 == 2.0 and out[1].failure_comp2 == 1.0 and out[1].failure == 1.0
    assert out[2].failure_comp1 == 0.0 and out[2].failure == 0.0  # null category: all zero
    assert out[3].failure_comp4 == 0.0 and out[3].failure == 1.0  # unlisted still flags
    assert discover_categories(_events(spark), "failure") == ["comp1", "comp2", "comp3", "comp9"]


def test_discovered_categories_sorted_columns(spark):
    out = onehot_counts(_events(spark), "failure", ["machineID", "datetime"], None, "f")
    assert out.columns == ["machineID", "datetime", "f_comp1", "f_comp2", "f_comp3", "f_comp9"]


def test_many_categories(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") % 1500).cast("string").alias("c"))
    assert len(discover_categories(df, "c")) == 1500
    got = {(r.k, r.category): r["count"] for r in category_counts(df, "c", ["k"]).collect()}
    wide = onehot_counts(df, "c", ["k"]).collect()
    assert got == {(r.k, c[2:]): r[c] for r in wide for c in r.asDict() if c != "k" and r[c] > 0}


def test_integers_are_exact(spark):
    rows = ["9007199254740993", "3.0", "007", "1.5", "x", None, "-9223372036854775808", "99999999999999999999", "1e3"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r.v for r in df.select("i", try_parse_integer("t").alias("v")).orderBy("i").collect()]
    assert got == [9007199254740993, 3, 7, None, None, None, -9223372036854775808, None, 1000]


def test_datetimes_with_zones_do_not_parse(spark):
    rows = ["2015-01-01 06:00:00+05:00", "2015-01-01T06:00:00Z", "2015-01-01 06:00:00", "1/2/2015", "Jan 2 2015 06:00", "2015/01/02"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [str(r.v) for r in df.select("i", try_parse_datetime("t").alias("v")).orderBy("i").collect()]
    assert got == ["None", "None", "2015-01-01 06:00:00", "2015-01-02 00:00:00", "2015-01-02 06:00:00", "2015-01-02 00:00:00"]


def test_combined_counts_equal_separate(spark):
    ev = _events(spark)
    maint = ev.withColumnRenamed("failure", "comp")
    combo = combined_event_counts([EventSpec(ev, "failure", "failure", ("comp1", "comp2"), "failure"),
                                   EventSpec(maint, "comp", "maint", ("comp1", "comp3"))],
                                  ["machineID", "datetime"])
    sep_f = onehot_counts(ev, "failure", ["machineID", "datetime"], ["comp1", "comp2"], "failure",
                          flag="failure")
    sep_m = onehot_counts(maint, "comp", ["machineID", "datetime"], ["comp1", "comp3"], "maint")
    joined = sep_f.join(sep_m, ["machineID", "datetime"], "full").na.fill(0.0)
    assert sorted(combo.collect()) == sorted(joined.select(*combo.columns).collect())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.sampled_from(["a", "b", "c", None])),
                min_size=1, max_size=40))
def test_property_cells_sum_to_events(spark, rows):
    df = spark.createDataFrame(rows, "k long, h long, c string")
    out = onehot_counts(df, "c", ["k", "h"], ["a", "b", "c"], "x", flag="any").collect()
    assert sum(r.x_a + r.x_b + r.x_c for r in out) == sum(1 for r in rows if r[2] is not None)
    assert len(out) == len({(r[0], r[1]) for r in rows})
    for r in out:
        assert r.any == (1.0 if r.x_a + r.x_b + r.x_c > 0 else 0.0)


def test_iso_texts_are_cast_as_their_form_reads_them(spark):
    texts = ["2024-01-31 06:00:00.123456", "2024-01-31 06:00:00.5", "2024-02-30 00:00:00.000000", "2024-01-01 24:00:00.0", "2024-01-01 23:59:60.0",
             "0000-01-01 00:00:00.0", "0999-12-31 00:00:00.25", "2024-01-31 06:00:00.123456789", "2024-1-31 06:00:00.1", "2024-01-31 06:00:00.1\n",
             "2024-01-31 06:00:00", "2024-01-31T06:00:00", "2024-01-31T06:00:00.75", "2024-03-10 02:30:00", "2023-02-29T00:00:00", "12024-01-01 00:00:00", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    for shape, pattern in fc.DATETIME_FORMS[:4]:
        plain = F.when((fc.datetime_shape("c") == shape) & F.try_to_timestamp("c", F.lit(pattern)).isNotNull(), F.to_timestamp_ntz("c", F.lit(pattern)))
        got = rows.select("c", fc.parse_datetime_as("c", pattern, strict=False).cast("string").alias("v"), plain.cast("string").alias("w")).collect()
        assert [r.v for r in got] == [r.w for r in got] and any(r.v for r in got)
        cast = rows.select(fc.parse_datetime_as("c", pattern, strict=False))._jdf.queryExecution().analyzed().toString()
        assert "RLIKE" in cast  # full ISO texts don't go through the pattern

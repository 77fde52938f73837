"""Bucketed (split) features equal per-machine features on random sparse hourly series."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmend.plans import features as FT

BASE = dt.datetime(2024, 1, 1)


@settings(max_examples=8, deadline=None)
@given(hours=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=60, unique=True),
       seed=st.integers(0, 1000), bucket=st.sampled_from([26, 30, 50, 168]))
def test_split_equals_per_machine(spark, hours, seed, bucket):
    rows = []
    for i, (m, h) in enumerate(sorted(hours)):
        v = ((seed + 7 * i) % 13) * 1.5
        rows.append((BASE + dt.timedelta(hours=h), m, v, float((seed + i) % 5),
                     1.0 if (seed + i) % 7 == 0 else 0.0, 1.0 if (seed + 3 * i) % 6 == 0 else 0.0,
                     float((seed + i) % 3 == 0)))
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, machineID long, volt double, rotate double, "
                                     "failure double, maint_comp1 double, errorID_error1 double")
    kw = dict(sensors=["volt"], windows_hours=(3, 24))
    a = {(r.machineID, r.datetime): r for r in FT.feature_table(df, bucket_hours=bucket, **kw).collect()}
    b = {(r.machineID, r.datetime): r for r in FT.feature_table(df, bucket_hours=None, **kw).collect()}
    assert a.keys() == b.keys() and len(a) == len(rows)
    for k in a:
        for col in a[k].__fields__:
            x, y = a[k][col], b[k][col]
            if isinstance(x, float) and isinstance(y, float):
                assert (math.isnan(x) and math.isnan(y)) or abs(x - y) <= 1e-9 * max(1.0, abs(y)), col
            else:
                assert x == y, col

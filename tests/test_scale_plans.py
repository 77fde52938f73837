"""The plans a large cluster gets (no broadcasts, many partitions) give the same results."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

LARGE_PLAN_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "37",
}
KEYS = ["master_table", "raw_gate_report", "merged_gate_report", "hours_since_maintenance",
        "label_24h", "lag_features", "latest_status", "sorted_master", "join_orders_customer",
        "duplicate_keys"]


@pytest.fixture
def large_plans(spark, monkeypatch):
    from sparkmend.operators import joins
    old = {k: spark.conf.get(k, None) for k in LARGE_PLAN_CONF}
    for k, v in LARGE_PLAN_CONF.items():
        spark.conf.set(k, v)
    # dimensions are never proven small enough to broadcast here
    monkeypatch.setattr(joins.left_join, "__defaults__", (None, 0))
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def small_plan_results(spark):
    return {k: sorted(map(tuple, E.queries()[k](spark, SF_SMALL).collect()), key=repr) for k in KEYS}


def test_large_cluster_plans_match(spark, small_plan_results, large_plans):
    for k in KEYS:
        df = E.queries()[k](spark, SF_SMALL)
        rows = sorted(map(tuple, df.collect()), key=repr)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan or k in ("sorted_master",), k
        assert rows == small_plan_results[k], k

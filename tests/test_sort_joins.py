"""Total order with positions, and size-checked broadcast joins."""

from pyspark.sql import functions as F

from sparkmend.operators.joins import left_join
from sparkmend.operators.sort import total_sort, with_position


def test_with_position_is_the_sorted_rank(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    out = with_position(df, ["g", "k"], partitions=7).toPandas()
    exp = out.sort_values(["g", "k"]).reset_index(drop=True)
    assert list(exp.row_index) == list(range(1, 5001))


def test_total_sort_orders_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"))
    parts = total_sort(df, ["k"], 4).rdd.glom().collect()
    flat = [r.k for p in parts for r in p]
    assert flat == sorted(flat)


def test_left_join_has_no_hint_and_no_job(spark):
    wide = spark.createDataFrame([(1, "x" * 1_000_000), (2, "y" * 1_000_000)], "k long, d string")
    fact = spark.range(10).withColumnRenamed("id", "k")
    joined = left_join(fact, wide, ["k"])
    assert "hint" not in joined._jdf.queryExecution().logical().toString().lower()
    assert joined.where("d is not null").count() == 2


def test_positions_need_one_shuffle(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("k"))
    out = with_position(df, ["k"], partitions=5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0
    assert [r.row_index for r in out.orderBy("k").collect()] == list(range(1, 3001))


def test_left_join_keeps_fact_rows_and_fans_out(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    dim = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, d string")
    out = left_join(fact, dim, ["k"]).collect()
    assert len(out) == 4  # key 1 fans out, 2 unmatched, null key never matches
    assert sorted((r.v, r.d) for r in out if r.v != "a") == [("b", None), ("c", None)]


def test_sorted_files_follow_data_size(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from sparkmend.operators import sort
    df = spark.range(0, 20000).select((F.col("id") * 7919 % 20000).alias("k"))
    assert sort.partitions_for(20000, df, target_bytes=16 * 20000) == 1
    monkeypatch.setattr(sort, "TARGET_PARTITION_BYTES", 16 * 2000)  # ~2,000 rows per file
    monkeypatch.setattr(sort.partitions_for, "__defaults__", (16 * 2000,))
    path = str(tmp_path / "sorted")
    sort.write_sorted(df, ["k"], path, rows=20000)
    files = sorted(glob.glob(f"{path}/part-*.parquet"))
    assert len(files) >= 5
    keys = [v for f in files for v in pq.read_table(f).column("k").to_pylist()]
    assert keys == sorted(keys) and len(keys) == 20000

"""Scratch tables: written under the checkpoint folder, released when they have been replaced."""

import os

import pytest
from pyspark.sql import functions as F

from sparkmend.session import SHUFFLE_CLEANUP, cut_lineage, local_path, release


def test_release_deletes_scratch_tables_only(spark, tmp_path):
    kept = cut_lineage(spark.range(10), "kept")
    gone = cut_lineage(kept.selectExpr("id + 1 AS id"), "gone")
    again = cut_lineage(gone.selectExpr("id * 2 AS id"), "again")
    mine = str(tmp_path / "mine")
    spark.range(3).write.parquet(mine)
    release(gone, spark.read.parquet(mine), cut_lineage(spark.range(0), "empty"))
    assert sorted(r.id for r in again.collect()) == list(range(2, 22, 2))
    assert kept.count() == 10 and spark.read.parquet(mine).count() == 3
    assert not any(os.path.exists(local_path(f)) for f in gone.inputFiles())
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_scratch_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    before, was = shuffles(), spark.conf.get(SHUFFLE_CLEANUP)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = cut_lineage(sums.join(sums.withColumnRenamed("count", "n"), "k"), "sums")
    assert table.count() == 7
    left = {f for f in shuffles() - before if f.endswith(".data")}
    # the count's own shuffle is one task's; the write's two aggregates and its join left none
    assert len(left) <= 1
    assert spark.conf.get(SHUFFLE_CLEANUP) == was
    with pytest.raises(Exception):
        cut_lineage(spark.range(3).select(F.raise_error(F.lit("no"))), "fails")
    assert spark.conf.get(SHUFFLE_CLEANUP) == was

"""Total order by key: range-partitioned sort, and an explicit 1-based position.

A total sort is range partitioning (one sampling job, then a shuffle) plus a sort
inside each partition; partition i holds only keys below those of partition i+1,
and a write turns partition i into file ``part-<i>``. The position of a row is
then the number of rows in earlier files plus its rank inside its own file. Only
one count per file reaches a tiny prefix sum, so no task ever holds more than
one range partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend.session import cut_lineage, scratch_path


def total_sort(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows ordered by ``keys`` across and within partitions (for sorted sinks)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


TARGET_PARTITION_BYTES = 256 * 1024 * 1024
_STRING_WIDTH_GUESS = 64
POSITION_ID = "__position_id"


def estimated_row_bytes(schema: T.StructType) -> int:
    """Rough size of a row (strings at a fixed guess): only steers how many files a sorted write makes."""
    total = 8
    for f in schema.fields:
        t = f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            total += _STRING_WIDTH_GUESS
        elif isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            total += 4 * _STRING_WIDTH_GUESS
        else:
            total += 16 if isinstance(t, T.DecimalType) else 8
    return total


def partitions_for(rows: int, df: DataFrame, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Range partitions of about ``target_bytes`` each for ``rows`` rows of ``df``'s schema."""
    return max(1, -(-rows * estimated_row_bytes(df.schema) // target_bytes))


def write_sorted(df: DataFrame, keys: list[str], path: str, partitions: int | None = None,
                 rows: int | None = None) -> None:
    """Write ``df`` as Parquet files whose name order is the key order.

    With a known row count the number of range partitions (and files) follows
    the data size, about 256 MiB each, instead of a fixed shuffle setting.
    """
    if partitions is None and rows is not None:
        partitions = partitions_for(rows, df)
    total_sort(df, keys, partitions).write.mode("overwrite").parquet(path)


def with_position(df: DataFrame, keys: list[str], name: str = "row_index",
                  partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order by ``keys``.

    The rows are written once as they come (their number is observed on the way, and sets the number of range partitions) and
    once in order (to ``path``, or a scratch table in the shared checkpoint folder). The sorted write also stores
    ``monotonically_increasing_id``: the partition's number and the row's rank in it. Positions are that
    rank plus the sizes of earlier partitions, one row a partition, so there is no further shuffle of the rows.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "sorted")
    staged = scratch_path(spark, "unsorted")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    ordered = total_sort(rows, keys, partitions or partitions_for(seen.get["rows"], rows))
    ordered.withColumn(POSITION_ID, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    part = F.shiftright(F.col(POSITION_ID), 33)
    rank = F.col(POSITION_ID) - F.shiftleft(part, 33)
    # one row a partition; written, so that the join below knows its real size
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = cut_lineage(sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "offsets")
    return (written.withColumn("__part", part).join(offsets, "__part", "left")
            .withColumn(name, F.col("__before") + rank + 1).drop("__part", "__before", POSITION_ID))

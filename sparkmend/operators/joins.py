"""Left outer equi-joins onto the preserved fact side.

No hint and no size guess: Spark broadcasts a side whose measured size (file statistics, or the
shuffle output that adaptive execution sees) is under ``spark.sql.autoBroadcastJoinThreshold``, and
otherwise shuffles both sides and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def left_join(fact: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``fact LEFT JOIN other USING (keys)``: every fact row kept, duplicates in ``other`` fan out.

    Keys compare with ``=``, so null keys never match (the gates forbid them first).
    """
    return fact.join(other, on=keys, how="left")

"""Data audits as aggregates: null cells, exact duplicate rows, duplicate keys, row counts.

Every audit is an aggregate that Spark computes with a map-side partial step,
so a hot key or a block of identical rows collapses inside each map task before
the shuffle. Nothing is collected except one small result row.

Null semantics follow the pandas reading of "missing": a null, or a NaN in a
floating column, is a missing cell. Grouping for duplicates treats null = null
and NaN = NaN, which is how Spark groups.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for float/double columns."""
    c = F.col(f"`{name}`")
    t = df.schema[name].dataType
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_cell_expr(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Aggregate expression: number of missing cells over ``cols`` (all columns by default)."""
    cols = df.columns if cols is None else [c for c in cols if c in df.columns]
    if not cols:
        return F.lit(0).cast("long")
    return reduce(add, [F.count_if(is_missing(df, c)) for c in cols]).cast("long")


def null_cells(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: ``null_cells``."""
    return df.agg(null_cell_expr(df, cols).alias("null_cells"))


def row_hashes(cols: list[str], prefix: str) -> list[Column]:
    """Two 64-bit hashes ``<prefix>0``, ``<prefix>1`` of the values of ``cols`` and of where they are null.

    Equal rows have equal hashes; rows that share hashes are candidates, which ``exact_surplus`` compares in full.
    """
    if not cols:
        return [F.lit(0).cast("long").alias(f"{prefix}{i}") for i in (0, 1)]
    values = [F.col(f"`{c}`") for c in cols]
    nulls = F.array(*[v.isNull() for v in values])
    return [F.xxhash64(F.lit(i), nulls, *values).alias(f"{prefix}{i}") for i in (0, 1)]


def exact_surplus(df: DataFrame, cols: list[str], candidates: DataFrame, prefix: str = "_h") -> DataFrame:
    """One row: ``surplus``, rows beyond the first of each group of equal values of ``cols``, compared in full.

    ``candidates`` holds the hashes (``<prefix>0``, ``<prefix>1``) that several rows share. Only their rows are shuffled and grouped by
    value; without candidates the join is empty and adaptive execution leaves the second scan out.
    """
    shared = candidates.select(F.col(f"{prefix}0").alias("__c0"), F.col(f"{prefix}1").alias("__c1"))
    rows = df.select(*row_hashes(cols, prefix), *[F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(cols)])
    rows = rows.join(shared, (F.col(f"{prefix}0") == F.col("__c0")) & (F.col(f"{prefix}1") == F.col("__c1")), "left_semi")
    return (rows.groupBy(f"{prefix}0", f"{prefix}1", *[f"__v{i}" for i in range(len(cols))]).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("surplus")))


def surplus_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``surplus`` = rows - distinct values of ``cols`` (rows beyond the first of each group).

    A first pass shuffles a 128-bit hash of the values and a count; rows whose hash occurs more than once are then compared in full.
    """
    groups = df.select(*row_hashes(cols, "_h")).groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("_n"))
    return exact_surplus(df, cols, groups.where("_n > 1"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: exact duplicate rows (all columns equal), counted beyond the first copy."""
    return surplus_rows(df, df.columns).withColumnRenamed("surplus", "duplicate_rows")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows whose key repeats an earlier row's key, and the number of such keys."""
    return (df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
                 F.count_if(F.col("_n") > 1).cast("long").alias("duplicated_keys")))


def table_profile(df: DataFrame, null_cols: list[str] | None = None) -> DataFrame:
    """One row: ``rows`` and ``null_cells`` in a single pass."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                  null_cell_expr(df, null_cols).alias("null_cells"))

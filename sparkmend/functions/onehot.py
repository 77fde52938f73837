"""One-hot counts of a categorical column per key.

A category column becomes one count column per value, named ``<prefix>_<value>``,
aggregated over the key. Cells are counts, not flags: two events of one kind on
one key give 2. A null category adds a row for its key with all counts zero;
null keys are dropped.

Each output cell is a conditional ``count``; Spark computes them all in one hash
aggregate with a map-side partial step, so a key that holds a third of all events
is reduced in every map task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MAX_COLUMNS = 10_000  # categories of the wide form: each becomes a column


def discover_categories(df: DataFrame, column: str, most: int = MAX_COLUMNS) -> list[str]:
    """Distinct non-null values of ``column``, sorted: the columns of the wide form.

    They become column names, so they are needed on the driver. A column with more than ``most`` values is refused with
    their number, before any more of them are brought there; ``category_counts`` keeps them as rows.
    """
    values = df.select(F.col(column).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = values.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {column} has {values.count()} different values, too many for columns (at most {most}); use category_counts")
    return sorted(r.v for r in rows)


def category_counts(df: DataFrame, column: str, keys: list[str], category: str = "category", count: str = "count") -> DataFrame:
    """One-hot counts in long form: a row for each key and category that occurs, any number of categories.

    The non-zero cells of ``onehot_counts``; nothing reaches the driver. Null keys and null categories have no row.
    """
    return (df.dropna(subset=[*keys, column]).groupBy(*keys, F.col(column).cast("string").alias(category))
            .agg(F.count(F.lit(1)).cast("double").alias(count)))


def onehot_count_exprs(column: str | Column, categories: list[str], prefix: str,
                       where: Column | None = None) -> list[Column]:
    """``count`` expressions, one per category, cast to double and named by prefix."""
    c = F.col(column) if isinstance(column, str) else column
    out = []
    for v in categories:
        cond = c == F.lit(v)
        if where is not None:
            cond = where & cond
        out.append(F.count(F.when(cond, F.lit(1))).cast("double").alias(f"{prefix}_{v}"))
    return out


def onehot_counts(df: DataFrame, column: str, keys: list[str], categories: list[str] | None = None,
                  prefix: str | None = None, flag: str | None = None) -> DataFrame:
    """Group ``df`` by ``keys`` and count each category of ``column``.

    ``categories=None`` discovers them first (one small distinct job). ``flag``
    names an extra 0/1 column set where any non-null category occurs on the key,
    which equals "some count above zero" also for categories not listed.
    """
    prefix = prefix or column
    cats = discover_categories(df, column) if categories is None else list(categories)
    keyed = df.dropna(subset=keys)
    aggs = onehot_count_exprs(column, cats, prefix)
    if flag:
        aggs.append((F.count(F.col(column)) > 0).cast("double").alias(flag))
    return keyed.groupBy(*keys).agg(*aggs)


@dataclass(frozen=True)
class EventSpec:
    """One sparse event table: its category column, output prefix and categories."""

    df: DataFrame
    column: str
    prefix: str
    categories: tuple[str, ...]
    flag: str | None = None


def combined_event_counts(specs: list[EventSpec], keys: list[str]) -> DataFrame:
    """One-hot counts of several event tables on the same key, in one aggregate.

    The tables are stacked as (keys..., kind, category) and grouped once, so the
    merge shuffles the events once instead of once per table, and joins the
    telemetry once instead of once per table. Output columns keep the order of
    ``specs``; a flag column follows the counts of its table.
    """
    long = None
    for i, s in enumerate(specs):
        part = s.df.select(*[F.col(k) for k in keys], F.lit(i).alias("_kind"),
                           F.col(s.column).cast("string").alias("_cat"))
        long = part if long is None else long.unionByName(part)
    long = long.dropna(subset=keys)
    aggs: list[Column] = []
    for i, s in enumerate(specs):
        is_kind = F.col("_kind") == F.lit(i)
        aggs.extend(onehot_count_exprs("_cat", list(s.categories), s.prefix, where=is_kind))
        if s.flag:
            aggs.append((F.count(F.when(is_kind, F.col("_cat"))) > 0).cast("double").alias(s.flag))
    return long.groupBy(*keys).agg(*aggs)

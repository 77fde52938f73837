"""Column expressions: time parsing and flooring, column choice, horizontal sums, flags, fills.

All of these are built-in Catalyst expressions, so they stay inside whole-stage
codegen; none of them starts a job.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text formats accepted for the raw `datetime` column, tried in order
# after the ISO form ("2015-01-01 06:00:00", "2015-01-01T06:00:00").
DATETIME_FORMATS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/MM/dd HH:mm:ss",
                    "yyyy/MM/dd H:mm", "yyyy/MM/dd", "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d yyyy", "yyyyMMdd"]
# A time zone at the end of a text: such values have no plain wall clock and do not parse.
ZONED = r"(?i)\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2}|[+-]\d{2})\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_parse_datetime(c: str | Column, formats: list[str] | None = None) -> Column:
    """Text -> timestamp_ntz, NULL where no accepted form matches (never raises).

    Text with a zone or offset is NULL too: dropping the offset would change the time.
    """
    c = _col(c)
    fmts = DATETIME_FORMATS if formats is None else formats
    # to_timestamp_ntz raises under ANSI, so it only runs where try_to_timestamp
    # has shown the format fits; the result keeps the wall clock (no zone shift).
    alts = [F.when(F.try_to_timestamp(c, F.lit(f)).isNotNull(), F.to_timestamp_ntz(c, F.lit(f)))
            for f in fmts]
    return F.when(~c.cast("string").rlike(ZONED), F.coalesce(c.try_cast("timestamp_ntz"), *alts))


def parse_datetime(c: str | Column, formats: list[str] | None = None, name: str = "datetime") -> Column:
    """Text -> timestamp_ntz; a non-null value that does not parse raises at run time."""
    c = _col(c)
    parsed = try_parse_datetime(c, formats)
    return F.when(c.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit(f"unparseable {name}: "), c))).otherwise(parsed)


# The forms that a whole datetime column may have, in order of precedence. ``9`` in a shape stands for a run of
# digits, ``a`` for a run of letters; the pattern decides within the shape. Month before day where both fit all values.
DATETIME_FORMS = [
    ("9-9-9 9:9:9", "yyyy-MM-dd HH:mm:ss"), ("9-9-9 9:9:9.9", "yyyy-MM-dd HH:mm:ss.[SSSSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    ("9-9-9a9:9:9", "yyyy-MM-dd'T'HH:mm:ss"), ("9-9-9a9:9:9.9", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    ("9-9-9 9:9", "yyyy-MM-dd HH:mm"), ("9-9-9a9:9", "yyyy-MM-dd'T'HH:mm"), ("9-9-9", "yyyy-MM-dd"),
    ("9/9/9 9:9:9 a", "M/d/yyyy h:mm:ss a"), ("9/9/9 9:9 a", "M/d/yyyy h:mm a"), ("9/9/9 9:9:9", "M/d/yyyy H:mm:ss"),
    ("9/9/9 9:9", "M/d/yyyy H:mm"), ("9/9/9", "M/d/yyyy"), ("9/9/9 9:9:9", "d/M/yyyy H:mm:ss"), ("9/9/9 9:9", "d/M/yyyy H:mm"),
    ("9/9/9", "d/M/yyyy"), ("9/9/9 9:9:9", "yyyy/MM/dd HH:mm:ss"), ("9/9/9 9:9", "yyyy/MM/dd H:mm"), ("9/9/9", "yyyy/MM/dd"),
    ("9-9-9 9:9:9", "M-d-yyyy H:mm:ss"), ("9-9-9 9:9:9", "d-M-yyyy H:mm:ss"), ("9-9-9", "M-d-yyyy"), ("9-9-9", "d-M-yyyy"),
    ("9.9.9 9:9:9", "d.M.yyyy H:mm:ss"), ("9.9.9 9:9", "d.M.yyyy H:mm"), ("9.9.9", "d.M.yyyy"),
    ("a 9 9 9:9:9", "MMM d yyyy HH:mm:ss"), ("a 9 9 9:9", "MMM d yyyy HH:mm"), ("a 9 9", "MMM d yyyy"), ("a 9, 9", "MMM d, yyyy"),
    ("9 a 9 9:9:9", "d MMM yyyy HH:mm:ss"), ("9 a 9", "d MMM yyyy"), ("9", "yyyyMMdd"),
]
SHAPE_OF = {pattern: shape for shape, pattern in DATETIME_FORMS}


def datetime_shape(c: str | Column) -> Column:
    """A text with runs of digits as ``9`` and runs of letters as ``a``."""
    return F.regexp_replace(F.regexp_replace(_col(c), "[A-Za-z]+", "a"), "[0-9]+", "9")


# Texts that a cast reads just as their form does, many times faster than by a pattern: ISO forms with all digits, from year 1000 on.
_ISO = r"\A[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}%s[0-9]{2}:[0-9]{2}:[0-9]{2}%s\z"
PLAIN_ISO = {pattern: _ISO % (" " if " " in shape else "T", r"\.[0-9]{1,6}" if shape.endswith(".9") else "")
             for shape, pattern in DATETIME_FORMS[:4]}


def _by_form(c: Column, shape: Column, pattern: str) -> Column:
    """The value by one form, NULL where it has another; only texts of the form's shape are parsed."""
    parsed = F.when((shape == F.lit(SHAPE_OF[pattern])) & F.try_to_timestamp(c, F.lit(pattern)).isNotNull(),
                    F.to_timestamp_ntz(c, F.lit(pattern)))
    if pattern not in PLAIN_ISO:
        return parsed
    return F.when(c.rlike(PLAIN_ISO[pattern]), c.try_cast("timestamp_ntz")).otherwise(parsed)


def datetime_votes(df: DataFrame, name: str = "datetime") -> DataFrame:
    """One row: ``form`` (the form that most values have), ``present`` (values that are not NULL), ``other`` (those that do not have it).

    One aggregate over the column, combined before the shuffle. ``other`` is 0 where one form fits the whole column.
    """
    rows = df.select(F.col(f"`{name}`").alias("c")).withColumn("s", datetime_shape("c"))
    quoted = [(shape, pattern.replace("'", "''")) for shape, pattern in DATETIME_FORMS]

    def fits(shape: str, pattern: str) -> Column:
        return (F.col("s") == F.lit(shape)) & (_by_form(F.col("c"), F.col("s"), pattern) if pattern in PLAIN_ISO else F.try_to_timestamp("c", F.lit(pattern))).isNotNull()

    votes = rows.groupBy().agg(F.count("c").alias("present"), *[
        F.count_if(fits(shape, pattern)).alias(f"v{i}") for i, (shape, pattern) in enumerate(DATETIME_FORMS)])
    best = ", ".join(f"named_struct('n', v{i}, 'i', {-i}, 'form', '{pattern}')" for i, (_, pattern) in enumerate(quoted))
    return votes.selectExpr("present", f"greatest({best}) AS b").selectExpr("if(b.n > 0, b.form, NULL) AS form", "present", "present - b.n AS other")


def parse_datetime_as(c: str | Column, pattern: str, name: str = "datetime", strict: bool = True) -> Column:
    """Text -> timestamp_ntz by one form; a value of another form raises at run time when ``strict``, else it is NULL."""
    c = _col(c)
    parsed = _by_form(c, datetime_shape(c), pattern)
    if not strict:
        return parsed
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit(f"unparseable {name}: "), c))).otherwise(parsed)


def try_parse_integer(c: str | Column, to: str = "bigint") -> Column:
    """Text -> integer without going through a double: digits as they are, else a decimal with a
    zero fraction (``3.0``); NULL where neither fits."""
    c = _col(c)
    d = c.try_cast("decimal(38,18)")
    return F.coalesce(c.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint"))).try_cast(to)


def hour_floor(c: str | Column) -> Column:
    """Truncate a timestamp_ntz to the hour without going through a time zone."""
    c = _col(c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.lit(0), F.lit(0))


def columns_with_prefix(df: DataFrame, prefix: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns named ``<prefix>_...``, in table order, minus ``exclude``."""
    return [c for c in df.columns if c.startswith(prefix + "_") and c not in exclude]


def columns_except(df: DataFrame, *excluded: list[str] | tuple[str, ...]) -> list[str]:
    """Columns of ``df`` that are in none of the ``excluded`` lists, in table order."""
    drop = {c for group in excluded for c in group}
    return [c for c in df.columns if c not in drop]


def horizontal_sum(cols: list[str | Column]) -> Column:
    """Row-wise sum that skips nulls; an empty list sums to 0."""
    if not cols:
        return F.lit(0.0)
    return reduce(add, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def any_positive_flag(cols: list[str | Column]) -> Column:
    """1.0 when the row-wise sum of ``cols`` is above zero, else 0.0."""
    return (horizontal_sum(cols) > 0).cast("double")


def with_failure_flag(df: DataFrame, prefix: str = "failure", target: str = "failure") -> DataFrame:
    """Add the target flag: any ``<prefix>_*`` count above zero (the target itself excluded)."""
    return df.withColumn(target, any_positive_flag(columns_with_prefix(df, prefix, (target,))))


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace nulls by 0 in ``cols`` only; every other column keeps its nulls."""
    return df.na.fill(0.0, subset=cols) if cols else df


def ntz_literal(value) -> Column:
    """A Python datetime as a timestamp_ntz literal (wall clock kept, no zone applied)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def ntz_epoch_micros(c: str | Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a timestamp_ntz, read as a wall clock."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(c))

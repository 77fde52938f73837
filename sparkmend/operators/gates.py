"""Quality gates: every rule becomes a report row, and ``enforce`` raises the first failure.

Report schema: ``dataset, rule_order, rule, violations, enforced, passed``.
``rule_order`` walks the tables in contract order and the rules in the order the
checks run, so sorting by it gives the first failure. ``enforced`` rules are the
ones whose failure stops the run; the others are stricter checks that are only
reported unless ``strict=True``.

Rules that depend only on the schema (column lists, types) are decided on the
driver from ``df.schema`` (no job). The data rules of a table all come from one
scan: identical rows are grouped once (with map-side partial aggregation), every
cell rule is counted per distinct row, and key rules group the reduced groups.
The report of all tables comes back in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmend import contracts as C
from sparkmend.functions.columns import try_parse_datetime, try_parse_integer
from sparkmend.operators import audits
from sparkmend.sources.csv import MALFORMED

REPORT_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("rule_order", T.IntegerType(), False),
    T.StructField("rule", T.StringType(), False),
    T.StructField("violations", T.LongType(), True),
    T.StructField("enforced", T.BooleanType(), False),
    T.StructField("passed", T.BooleanType(), True),
])

REPORT_ROW = Row(*REPORT_SCHEMA.fieldNames())

# Rule names in check order, and the messages a failed rule raises.
RAW_RULES = ["file_exists", "columns_match", "null_cells", "duplicate_rows", "duplicate_keys",
             "unparseable_values", "unlisted_categories", "duplicate_machine_ids", "malformed_rows", "mixed_datetimes"]
MERGED_RULES = ["row_count_match", "duplicate_keys", "required_columns", "null_sensor_cells",
                "null_machine_cells", "numeric_event_columns"]
RAW_MESSAGES = {
    "file_exists": "no file for table {dataset} at {path}",
    "columns_match": "table {dataset}: the columns are {actual}, the contract has {expected}",
    "null_cells": "table {dataset}: some cells are missing",
    "duplicate_rows": "table {dataset}: some rows occur more than once",
    "duplicate_keys": "table {dataset}: a machine has two rows for one time",
    "unparseable_values": "table {dataset}: some values are not of the declared type",
    "unlisted_categories": "table {dataset}: some categories are not in the declared list",
    "duplicate_machine_ids": "table {dataset}: a machine id occurs more than once",
    "malformed_rows": "table {dataset}: some rows have more cells than the header",
    "mixed_datetimes": "table {dataset}: the datetime values do not all have one form",
}
MERGED_MESSAGES = {
    "row_count_match": "the merge changed the number of rows: {actual} instead of {expected}",
    "duplicate_keys": "the merged table has two rows for one machine and time",
    "required_columns": "the merged table lacks column {column}",
    "null_sensor_cells": "the merged table has missing sensor values",
    "null_machine_cells": "the merged table has missing machine metadata",
    "numeric_event_columns": "event column {column} is not numeric",
}
# Rules of the reference gate; the others are reported, and enforced only in strict mode.
REFERENCE_RAW_RULES = {"file_exists", "columns_match", "null_cells", "duplicate_rows",
                       "duplicate_keys", "malformed_rows", "mixed_datetimes"}


class _Fields(dict):
    """Message fields; a field without a value prints as ``?``."""

    def __missing__(self, key):
        return "?"


class GateError(ValueError):
    """A gate rule failed; ``rule`` names it, ``dataset`` the table."""

    def __init__(self, message: str, dataset: str, rule: str):
        super().__init__(message)
        self.dataset = dataset
        self.rule = rule


@dataclass
class RawInput:
    """A raw table as read (``df=None`` when its file is missing).

    ``headers``: (columns, number of files) of each header among its files. ``datetime_form`` and ``other_datetimes``: the form that most
    values of its datetime column have, and the number of values that do not have it. Both are empty for tables that are no files.
    """

    name: str
    df: DataFrame | None
    path: str = ""
    headers: tuple[tuple[tuple[str, ...], int], ...] = ()
    datetime_form: str | None = None
    other_datetimes: int | None = None

    def wrong_headers(self, expected: list[str]) -> list[tuple[tuple[str, ...], int]]:
        """Headers that differ from the expected columns, with the number of files that have them."""
        own = tuple(c for c in self.df.columns if c != MALFORMED)
        return [h for h in self.headers or ((own, 1),) if list(h[0]) != list(expected)]


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _is_text_table(df: DataFrame, contract: C.TableContract) -> bool:
    """True when declared non-string columns arrive as strings (raw text files)."""
    for f in contract.schema.fields:
        if f.name in df.columns and not isinstance(f.dataType, T.StringType):
            if isinstance(df.schema[f.name].dataType, T.StringType):
                return True
    return False


def typed_value(df: DataFrame, name: str, target: T.DataType) -> Column:
    """The declared-type value of a text cell (NULL where it does not parse)."""
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType) or isinstance(target, T.StringType):
        return c
    if isinstance(target, T.TimestampNTZType):
        return try_parse_datetime(c)
    if isinstance(target, (T.LongType, T.IntegerType)):
        return try_parse_integer(c, target.simpleString())
    return c.try_cast(target.simpleString())


def _rule_struct(dataset: str, order: int, rule: str, violations: Column, enforced: bool
                 ) -> Column:
    v = violations.cast("long")
    return F.struct(F.lit(dataset).alias("dataset"), F.lit(order).cast("int").alias("rule_order"),
                    F.lit(rule).alias("rule"), v.alias("violations"),
                    F.lit(enforced).alias("enforced"), (v == 0).alias("passed"))


def _rows_from(one_row: DataFrame, rules: list[Column], rows: Column | None = None) -> DataFrame:
    """Turn one row of statistics into report rows (no further job); ``rows`` adds a column."""
    extra = [rows.cast("long").alias("rows")] if rows is not None else []
    return one_row.select(F.inline(F.array(*rules)), *extra)


def _count_true(conds: list[Column]) -> Column:
    """Number of true conditions in a row (0 for an empty list)."""
    if not conds:
        return F.lit(0)
    return sum((c.cast("int") for c in conds[1:]), conds[0].cast("int"))


def value_view(df: DataFrame, contract: C.TableContract) -> tuple[DataFrame, dict[str, list[str]]]:
    """Columns compared by value, without formatting anything back to text.

    A text column declared non-string becomes two columns: its parsed value
    (NULL where it does not parse) and its text where it does not parse (else
    NULL). Two cells are then equal when they parse to the same value (as for a
    typed reader: ``7`` equals ``7.0``) or are the same unparseable text.
    Returns the view and, per original column, the view columns that stand for it.
    """
    types = {f.name: f.dataType for f in contract.schema.fields}
    out, parts = [], {}
    for name in df.columns:
        if name == MALFORMED:
            out.append(F.col(name))
            continue
        t = types.get(name)
        raw = F.col(f"`{name}`")
        if t is not None and not isinstance(t, T.StringType) \
                and isinstance(df.schema[name].dataType, T.StringType):
            v = typed_value(df, name, t)
            out += [v.alias(f"{name}__v"), F.when(raw.isNotNull() & v.isNull(), raw).alias(f"{name}__x")]
            parts[name] = [f"{name}__v", f"{name}__x"]
        else:
            out.append(raw.alias(name))
            parts[name] = [name]
    return df.select(*out), parts


def table_gate_stats(df: DataFrame, contract: C.TableContract, key: list[str] | None = None) -> tuple[DataFrame, bool]:
    """All data rules of one table from a single scan: returns (one stats row, text mode).

    Rows are grouped by a 128-bit hash of their values (and of their key): the shuffle carries hashes and counters
    only, whatever the width of the table, and copies collapse before it. Missing cells, unparseable cells and
    unlisted categories are summed over the groups. Rows and keys whose hash occurs more than once are candidates for duplicates; they
    are read again and compared in full (``audits.exact_surplus``), which a table without candidates is spared.
    """
    text = _is_text_table(df, contract)
    marked = MALFORMED in df.columns
    plain = df.drop(MALFORMED)
    view, parts = value_view(df, contract) if text else (df, {c: [c] for c in plain.columns})
    missing, bad, unlisted = _row_rule_counts(view, parts, contract)
    wrong = F.col(MALFORMED).cast("int") if marked else F.lit(0)
    keyed = bool(key) and all(k in parts for k in key)
    key_cols = [c for k in key for c in parts[k]] if keyed else []
    rows = view.select(*audits.row_hashes([c for c in view.columns if c != MALFORMED], "_h"), *(audits.row_hashes(key_cols, "_k") if keyed else []),
                       missing.alias("_m"), bad.alias("_b"), unlisted.alias("_u"), wrong.alias("_w"))
    names = [c for c in rows.columns if c[:2] in ("_h", "_k")]
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in ("_m", "_b", "_u", "_w")])

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    stats = groups.agg(
        total(F.col("_n")).alias("rows"), total(F.col("_m")).alias("null_cells"),
        total(F.col("_b")).alias("unparseable_values"), total(F.col("_u")).alias("unlisted_categories"),
        total(F.col("_w")).alias("malformed_rows"))
    values = [c for c in view.columns if c != MALFORMED]
    exact = [audits.exact_surplus(view, values, groups.groupBy("_h0", "_h1").agg(F.sum("_n").alias("_n")).where("_n > 1"))
             .withColumnRenamed("surplus", "duplicate_rows")]
    if keyed:
        per_key = groups.groupBy("_k0", "_k1").agg(F.sum("_n").alias("_n")).where("_n > 1")
        exact.append(audits.exact_surplus(view, key_cols, per_key, "_k").withColumnRenamed("surplus", "duplicate_keys"))
    names = [*stats.columns, *[c for e in exact for c in e.columns]]
    for e in exact:
        stats = stats.unionByName(e, allowMissingColumns=True)
    stats = stats.agg(*[F.max(c).alias(c) for c in names])
    return stats, text


def _row_rule_counts(view: DataFrame, parts: dict[str, list[str]], contract: C.TableContract
                     ) -> tuple[Column, Column, Column]:
    """Per row: missing cells, unparseable cells, unlisted category (0/1)."""
    missing_conds, bad_conds = [], []
    for name, cols in parts.items():
        if len(cols) == 2:
            v, x = F.col(f"`{cols[0]}`"), F.col(f"`{cols[1]}`")
            missing_conds.append(v.isNull() & x.isNull())
            bad_conds.append(x.isNotNull())
        else:
            missing_conds.append(audits.is_missing(view, cols[0]))
    if contract.categorical and contract.categorical in view.columns:
        cat = F.col(contract.categorical)
        unlisted = (cat.isNotNull() & ~cat.isin(*contract.categories)).cast("int")
    else:
        unlisted = F.lit(0)
    return _count_true(missing_conds), _count_true(bad_conds), unlisted


def raw_gate_report(spark: SparkSession, tables: list[RawInput] | dict[str, DataFrame | None],
                    contracts: dict[str, C.TableContract] | None = None,
                    strict: bool = False, with_rows: bool = False) -> DataFrame:
    """Report of the raw gate over the raw tables, one row per table and rule.

    One scan per table; all five tables run in one job. ``with_rows`` adds each
    table's row count as a column (so later checks need not count it again).
    """
    contracts = C.raw_contracts() if contracts is None else contracts
    if isinstance(tables, dict):
        tables = [RawInput(n, d) for n, d in tables.items()]
    by_name = {t.name: t for t in tables}
    parts: list[DataFrame] = []
    for ti, name in enumerate(contracts):
        contract = contracts[name]
        base = (ti + 1) * 100
        t = by_name.get(name, RawInput(name, None))
        enf = {r: (r in REFERENCE_RAW_RULES) or strict for r in RAW_RULES}
        if t.df is None:
            parts.append(_rows_from(spark.range(1), [
                _rule_struct(name, base + 1, "file_exists", F.lit(1), enf["file_exists"]),
                _rule_struct(name, base + 2, "columns_match", F.lit(None), enf["columns_match"])],
                F.lit(None) if with_rows else None))
            continue
        df = t.df
        if name == "telemetry":
            key = list(contract.key)
        elif name == "machines":
            key = ["machineID"]
        else:
            key = None
        stats, text = table_gate_stats(df, contract, key)
        rules = [
            _rule_struct(name, base + 1, "file_exists", F.lit(0), enf["file_exists"]),
            _rule_struct(name, base + 2, "columns_match",
                         F.lit(sum(files for _, files in t.wrong_headers(contract.columns))), enf["columns_match"]),
            _rule_struct(name, base + 3, "null_cells", F.col("null_cells"), enf["null_cells"]),
            _rule_struct(name, base + 4, "duplicate_rows", F.col("duplicate_rows"),
                         enf["duplicate_rows"]),
        ]
        if name == "telemetry":
            v = F.col("duplicate_keys") if "duplicate_keys" in stats.columns else F.lit(None)
            rules.append(_rule_struct(name, base + 5, "duplicate_keys", v, enf["duplicate_keys"]))
        if MALFORMED in df.columns:
            rules.append(_rule_struct(name, base + 9, "malformed_rows", F.col("malformed_rows"), enf["malformed_rows"]))
        if t.other_datetimes is not None:  # known when the tables are merged: after all other rules
            rules.append(_rule_struct(name, (len(contracts) + 1) * 100 + ti, "mixed_datetimes", F.lit(t.other_datetimes), enf["mixed_datetimes"]))
        if text:
            rules.append(_rule_struct(name, base + 6, "unparseable_values",
                                      F.col("unparseable_values"), enf["unparseable_values"]))
        if contract.categorical and contract.categorical in df.columns:
            rules.append(_rule_struct(name, base + 7, "unlisted_categories",
                                      F.col("unlisted_categories"), enf["unlisted_categories"]))
        if name == "machines" and "duplicate_keys" in stats.columns:
            rules.append(_rule_struct(name, base + 8, "duplicate_machine_ids",
                                      F.col("duplicate_keys"), enf["duplicate_machine_ids"]))
        parts.append(_rows_from(stats, rules, F.col("rows") if with_rows else None))
    return _union(parts)


def merged_gate_report(master: DataFrame, telemetry: DataFrame | int,
                       key: tuple[str, ...] = tuple(C.KEY_COLUMNS)) -> DataFrame:
    """Report of the merged gate: row counts, key uniqueness, required columns, nulls, types.

    One grouping of the master by key yields rows, surplus keys and the null
    counts (summed per key first); telemetry contributes only its row count,
    which may be passed as a number already known (from the raw gate).
    """
    name = C.MASTER.name
    required = C.SENSOR_COLUMNS + C.MACHINE_COLUMNS
    missing = [c for c in required if c not in master.columns]
    sensor_nulls = _count_true([audits.is_missing(master, c) for c in C.SENSOR_COLUMNS
                                if c in master.columns])
    machine_nulls = _count_true([audits.is_missing(master, c) for c in C.MACHINE_COLUMNS
                                 if c in master.columns])
    has_key = all(k in master.columns for k in key)
    grouping = [F.col(k) for k in key] if has_key else [F.lit(0).alias("_all")]
    per_key = master.groupBy(*grouping).agg(F.count(F.lit(1)).alias("_n"),
                                            F.sum(sensor_nulls).alias("_s"),
                                            F.sum(machine_nulls).alias("_m"))
    m_stats = per_key.agg(F.sum("_n").alias("m_rows"), F.sum(F.col("_n") - 1).alias("dup"),
                          F.sum("_s").alias("s"), F.sum("_m").alias("mm"))
    if isinstance(telemetry, int):
        t_stats = master.sparkSession.range(1).select(F.lit(telemetry).cast("long").alias("t_rows"))
    else:
        t_stats = telemetry.agg(F.count(F.lit(1)).alias("t_rows"))
    both = m_stats.unionByName(t_stats, allowMissingColumns=True).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ["m_rows", "dup", "s", "mm", "t_rows"]])
    rules = [
        _rule_struct(name, 1, "row_count_match", F.abs(F.col("m_rows") - F.col("t_rows")), True),
        _rule_struct(name, 2, "duplicate_keys", F.col("dup") if has_key else F.lit(None), True),
        _rule_struct(name, 3, "required_columns", F.lit(len(missing)), True),
        _rule_struct(name, 4, "null_sensor_cells", F.col("s"), True),
        _rule_struct(name, 5, "null_machine_cells", F.col("mm"), True),
        _rule_struct(name, 6, "numeric_event_columns",
                     F.lit(len(non_numeric_event_columns(master))), True),
    ]
    return _rows_from(both, rules)


def event_columns_of(df: DataFrame) -> list[str]:
    """Event columns by name: the one-hot prefixes and the target."""
    prefixes = tuple(p + "_" for p in (C.FAILURE_PREFIX, C.MAINTENANCE_PREFIX, C.ERROR_PREFIX))
    return [c for c in df.columns if c.startswith(prefixes) or c == C.TARGET_COLUMN]


def non_numeric_event_columns(df: DataFrame) -> list[str]:
    """Event columns whose type is neither numeric nor boolean (booleans count as numeric)."""
    return [c for c in event_columns_of(df)
            if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]


def enforce(report: DataFrame | list[Row], details: dict[tuple[str, str], dict] | None = None) -> bool:
    """Raise ``GateError`` for the first failed enforced rule (in ``rule_order``), else True.

    The report has a handful of rows per table; collecting it is bounded. Rows that are
    collected already can be given as a list.
    """
    details = details or {}
    rows = sorted(report if isinstance(report, list) else report.collect(), key=lambda r: r.rule_order)
    for r in rows:
        if r.enforced and r.passed is not True and r.violations is not None:
            messages = MERGED_MESSAGES if r.dataset == C.MASTER.name else RAW_MESSAGES
            fmt = _Fields(details.get((r.dataset, r.rule), {}))
            fmt.setdefault("dataset", r.dataset)
            msg = messages[r.rule].format_map(fmt)
            if r.rule == "file_exists":
                raise FileNotFoundError(msg)
            raise GateError(msg, r.dataset, r.rule)
    return True


def raw_details(tables: list[RawInput], contracts: dict[str, C.TableContract] | None = None
                ) -> dict[tuple[str, str], dict]:
    """Message fields for the raw gate (paths, expected and actual columns)."""
    contracts = C.raw_contracts() if contracts is None else contracts
    out: dict[tuple[str, str], dict] = {}
    for t in tables:
        out[(t.name, "file_exists")] = {"path": t.path}
        if t.df is not None and t.name in contracts:
            wrong = t.wrong_headers(contracts[t.name].columns)
            own = [c for c in t.df.columns if c != MALFORMED]
            out[(t.name, "columns_match")] = {"expected": contracts[t.name].columns, "actual": list(wrong[0][0]) if wrong else own}
    return out


def merged_details(master: DataFrame, master_rows: int | None = None,
                   telemetry_rows: int | None = None) -> dict[tuple[str, str], dict]:
    """Message fields for the merged gate."""
    missing = [c for c in C.SENSOR_COLUMNS + C.MACHINE_COLUMNS if c not in master.columns]
    bad = non_numeric_event_columns(master)
    out = {(C.MASTER.name, "row_count_match"): {"expected": telemetry_rows, "actual": master_rows}}
    if missing:
        out[(C.MASTER.name, "required_columns")] = {"column": missing[0]}
    if bad:
        out[(C.MASTER.name, "numeric_event_columns")] = {"column": bad[0]}
    return out

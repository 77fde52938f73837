"""Registered queries over the driver tables, and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
driver tables. Each oracle is ANSI SQL over the same tables (registered as views
by the checker); column names and types match the Spark result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a query (and its oracle SQL, if any) to the registry."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# The contract tables as SQL over the driver tables (same rules as sources.standins).
STANDIN_CTES = """
telemetry AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, user_id AS machineID,
         max(value) AS volt, min(value) AS rotate, CAST(count(*) AS DOUBLE) AS pressure,
         max(value) - min(value) AS vibration
  FROM events GROUP BY user_id, date_trunc('hour', ts)),
machines AS (
  SELECT c_custkey AS machineID, c_mktsegment AS model, CAST(c_nationkey AS BIGINT) AS age
  FROM customer),
errors AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, user_id AS machineID,
         'error' || CAST(1 + event_id % 5 AS VARCHAR) AS errorID
  FROM events WHERE event_type = 'error'),
failures AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, user_id AS machineID,
         'comp' || CAST(1 + event_id % 4 AS VARCHAR) AS failure
  FROM events WHERE event_type = 'purchase'),
maintenance AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, user_id AS machineID,
         'comp' || CAST(1 + event_id % 4 AS VARCHAR) AS comp
  FROM events WHERE event_type = 'signup')"""


def _cnt(col: str, value: str, alias: str) -> str:
    return f"CAST(SUM(CASE WHEN {col} = '{value}' THEN 1 ELSE 0 END) AS DOUBLE) AS {alias}"


ONEHOT_CTES = f"""
failures_agg AS (
  SELECT machineID, datetime,
         {_cnt('failure', 'comp1', 'failure_comp1')}, {_cnt('failure', 'comp2', 'failure_comp2')},
         {_cnt('failure', 'comp3', 'failure_comp3')}, {_cnt('failure', 'comp4', 'failure_comp4')},
         CAST(CASE WHEN count(failure) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS failure
  FROM failures WHERE machineID IS NOT NULL AND datetime IS NOT NULL GROUP BY machineID, datetime),
maint_agg AS (
  SELECT machineID, datetime,
         {_cnt('comp', 'comp1', 'maint_comp1')}, {_cnt('comp', 'comp2', 'maint_comp2')},
         {_cnt('comp', 'comp3', 'maint_comp3')}, {_cnt('comp', 'comp4', 'maint_comp4')}
  FROM maintenance WHERE machineID IS NOT NULL AND datetime IS NOT NULL GROUP BY machineID, datetime),
errors_agg AS (
  SELECT machineID, datetime,
         {_cnt('errorID', 'error1', 'errorID_error1')}, {_cnt('errorID', 'error2', 'errorID_error2')},
         {_cnt('errorID', 'error3', 'errorID_error3')}, {_cnt('errorID', 'error4', 'errorID_error4')},
         {_cnt('errorID', 'error5', 'errorID_error5')}
  FROM errors WHERE machineID IS NOT NULL AND datetime IS NOT NULL GROUP BY machineID, datetime)"""

EVENT_COLS = ["failure_comp1", "failure_comp2", "failure_comp3", "failure_comp4", "failure",
              "maint_comp1", "maint_comp2", "maint_comp3", "maint_comp4",
              "errorID_error1", "errorID_error2", "errorID_error3", "errorID_error4",
              "errorID_error5"]

MASTER_CTE = """
master AS (
  SELECT t.datetime, t.machineID, t.volt, t.rotate, t.pressure, t.vibration, m.model, m.age,
         {fills}
  FROM telemetry t
  LEFT JOIN machines m ON t.machineID = m.machineID
  LEFT JOIN failures_agg f ON t.machineID = f.machineID AND t.datetime = f.datetime
  LEFT JOIN maint_agg mt ON t.machineID = mt.machineID AND t.datetime = mt.datetime
  LEFT JOIN errors_agg e ON t.machineID = e.machineID AND t.datetime = e.datetime)""".format(
    fills=",\n         ".join(f"COALESCE({c}, 0.0) AS {c}" for c in EVENT_COLS))

MASTER_WITH = f"WITH {STANDIN_CTES},{ONEHOT_CTES},{MASTER_CTE}"


@register("master_table", f"{MASTER_WITH}\nSELECT * FROM master")
def q_master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the master table merged from the five contract tables (pinned schema)."""
    from sparkmend.plans.master import master_from_standins
    return master_from_standins(spark, sf_dir)


@register("master_discovered", f"{MASTER_WITH}\nSELECT * FROM master")
def q_master_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master with the categories found in the data (sorted), as a one-hot encoder emits
    them; here every declared category occurs, so the schema equals the pinned one."""
    from sparkmend.plans.master import master_from_standins
    return master_from_standins(spark, sf_dir, discover=True)


# ---------------------------------------------------------------------------
# One-hot counts, flag, fill, joins

def _standins(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from sparkmend.sources import standins as S
    return S.raw_tables(spark, sf_dir)


@register("onehot_failures", f"WITH {STANDIN_CTES},{ONEHOT_CTES}\nSELECT * FROM failures_agg")
def q_onehot_failures(spark, sf_dir):
    """Failure counts per component and the 0/1 failure flag, per (machine, hour)."""
    from sparkmend import contracts as C
    from sparkmend.functions.onehot import onehot_counts
    return onehot_counts(_standins(spark, sf_dir)["failures"], "failure", C.KEY_COLUMNS,
                         C.FAILURE_CATEGORIES, C.FAILURE_PREFIX, flag=C.TARGET_COLUMN)


@register("onehot_maintenance", f"WITH {STANDIN_CTES},{ONEHOT_CTES}\nSELECT * FROM maint_agg")
def q_onehot_maintenance(spark, sf_dir):
    """Maintenance counts per component, per (machine, hour)."""
    from sparkmend import contracts as C
    from sparkmend.functions.onehot import onehot_counts
    return onehot_counts(_standins(spark, sf_dir)["maintenance"], "comp", C.KEY_COLUMNS,
                         C.MAINTENANCE_CATEGORIES, C.MAINTENANCE_PREFIX)


@register("onehot_errors", f"WITH {STANDIN_CTES},{ONEHOT_CTES}\nSELECT * FROM errors_agg")
def q_onehot_errors(spark, sf_dir):
    """Error counts per error kind, per (machine, hour)."""
    from sparkmend import contracts as C
    from sparkmend.functions.onehot import onehot_counts
    return onehot_counts(_standins(spark, sf_dir)["errors"], "errorID", C.KEY_COLUMNS,
                         C.ERROR_CATEGORIES, C.ERROR_PREFIX)


@register("onehot_returnflag", """
SELECT l_orderkey,
       CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS l_returnflag_A,
       CAST(SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS l_returnflag_N,
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS l_returnflag_R
FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""")
def q_onehot_returnflag(spark, sf_dir):
    """Discovered categories (sorted, as a one-hot encoder would emit them) on lineitem."""
    from sparkmend.functions.onehot import onehot_counts
    from sparkmend.sources.standins import table
    li = table(spark, sf_dir, "lineitem")
    return onehot_counts(li, "l_returnflag", ["l_orderkey"], categories=None)


@register("failure_flag", f"WITH {STANDIN_CTES},{ONEHOT_CTES}\nSELECT * FROM failures_agg")
def q_failure_flag(spark, sf_dir):
    """Flag from the row-wise sum of the failure_* counts (A11 + A20)."""
    from sparkmend import contracts as C
    from sparkmend.functions.columns import with_failure_flag
    from sparkmend.functions.onehot import onehot_counts
    counts = onehot_counts(_standins(spark, sf_dir)["failures"], "failure", C.KEY_COLUMNS,
                           C.FAILURE_CATEGORIES, C.FAILURE_PREFIX)
    return with_failure_flag(counts, C.FAILURE_PREFIX, C.TARGET_COLUMN)


@register("zero_fill", f"""WITH {STANDIN_CTES},{ONEHOT_CTES}
SELECT t.*, m.model, m.age,
       COALESCE(e.errorID_error1, 0.0) AS errorID_error1, COALESCE(e.errorID_error2, 0.0) AS errorID_error2,
       COALESCE(e.errorID_error3, 0.0) AS errorID_error3, COALESCE(e.errorID_error4, 0.0) AS errorID_error4,
       COALESCE(e.errorID_error5, 0.0) AS errorID_error5
FROM telemetry t
LEFT JOIN machines m ON t.machineID = m.machineID
LEFT JOIN errors_agg e ON t.machineID = e.machineID AND t.datetime = e.datetime""")
def q_zero_fill(spark, sf_dir):
    """Event counts zero-filled after a left join; only the event columns are filled
    (metadata nulls of unmatched machines stay NULL, tested on hand-made rows)."""
    from sparkmend import contracts as C
    from sparkmend.functions.columns import zero_fill
    from sparkmend.functions.onehot import onehot_counts
    from sparkmend.operators.joins import left_join
    t = _standins(spark, sf_dir)
    counts = onehot_counts(t["errors"], "errorID", C.KEY_COLUMNS, C.ERROR_CATEGORIES, C.ERROR_PREFIX)
    merged = left_join(t["telemetry"], t["machines"], ["machineID"])
    merged = merged.join(counts, C.KEY_COLUMNS, "left")
    return zero_fill(merged, C.ERROR_COUNT_COLUMNS)


@register("join_machine_dim", f"""WITH {STANDIN_CTES}
SELECT t.*, m.model, m.age FROM telemetry t LEFT JOIN machines m ON t.machineID = m.machineID""")
def q_join_machine_dim(spark, sf_dir):
    """Telemetry LEFT JOIN machines (size-checked broadcast)."""
    from sparkmend.operators.joins import left_join
    t = _standins(spark, sf_dir)
    return left_join(t["telemetry"], t["machines"], ["machineID"])


@register("join_orders_customer", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
       c.c_name, c.c_nationkey, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_join_orders_customer(spark, sf_dir):
    """orders LEFT JOIN customer: the same join at a larger scale (checked broadcast or shuffle)."""
    from pyspark.sql import functions as F

    from sparkmend.operators.joins import left_join
    from sparkmend.sources.standins import table
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    return left_join(orders, cust, ["o_custkey"])


# ---------------------------------------------------------------------------
# Audits (A21-A25)

_AUDIT_TABLES = {
    "telemetry": ["datetime", "machineID", "volt", "rotate", "pressure", "vibration"],
    "errors": ["datetime", "machineID", "errorID"],
    "failures": ["datetime", "machineID", "failure"],
    "machines": ["machineID", "model", "age"],
    "maintenance": ["datetime", "machineID", "comp"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
}
_DOUBLE_COLS = {"volt", "rotate", "pressure", "vibration", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"}


def _null_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"count_if({c} IS NULL)")
        if c in _DOUBLE_COLS:
            parts.append(f"count_if(isnan({c}))")
    return " + ".join(parts)


def _audit_frames(spark, sf_dir):
    from sparkmend.sources.standins import table
    t = _standins(spark, sf_dir)
    t["lineitem"] = table(spark, sf_dir, "lineitem")
    return t


@register("null_audit", f"WITH {STANDIN_CTES}\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS dataset, count(*) AS rows, CAST({_null_sql(cols)} AS BIGINT) AS null_cells FROM {n}"
    for n, cols in _AUDIT_TABLES.items()))
def q_null_audit(spark, sf_dir):
    """Rows and missing cells (null, or NaN in floating columns) per table, one pass each."""
    from pyspark.sql import functions as F

    from sparkmend.operators.audits import table_profile
    out = None
    for name, df in _audit_frames(spark, sf_dir).items():
        row = table_profile(df).select(F.lit(name).alias("dataset"), "rows", "null_cells")
        out = row if out is None else out.unionByName(row)
    return out


@register("duplicate_rows", f"WITH {STANDIN_CTES}\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS dataset, (SELECT count(*) FROM {n}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {n})) AS duplicate_rows"
    for n in _AUDIT_TABLES))
def q_duplicate_rows(spark, sf_dir):
    """Exact duplicate rows per table (rows beyond the first copy)."""
    from pyspark.sql import functions as F

    from sparkmend.operators.audits import duplicate_rows
    out = None
    for name, df in _audit_frames(spark, sf_dir).items():
        row = duplicate_rows(df).select(F.lit(name).alias("dataset"), "duplicate_rows")
        out = row if out is None else out.unionByName(row)
    return out


_KEYS = {"telemetry": ["machineID", "datetime"], "machines": ["machineID"],
         "lineitem": ["l_orderkey", "l_linenumber"]}


@register("duplicate_keys", f"WITH {STANDIN_CTES}\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS dataset, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows, "
    f"CAST(count_if(n > 1) AS BIGINT) AS duplicated_keys FROM (SELECT count(*) AS n FROM {n} GROUP BY {', '.join(k)})"
    for n, k in _KEYS.items()))
def q_duplicate_keys(spark, sf_dir):
    """Surplus rows and duplicated keys on each table's key."""
    from pyspark.sql import functions as F

    from sparkmend.operators.audits import duplicate_keys
    frames = _audit_frames(spark, sf_dir)
    out = None
    for name, key in _KEYS.items():
        row = duplicate_keys(frames[name], key).select(F.lit(name).alias("dataset"), "duplicate_rows",
                                                      "duplicated_keys")
        out = row if out is None else out.unionByName(row)
    return out


@register("row_count_gate", f"""{MASTER_WITH}
SELECT (SELECT count(*) FROM master) AS master_rows, (SELECT count(*) FROM telemetry) AS telemetry_rows,
       (SELECT count(*) FROM master) = (SELECT count(*) FROM telemetry) AS rows_match""")
def q_row_count_gate(spark, sf_dir):
    """Master rows against telemetry rows (a fan-out shows as a difference)."""
    from pyspark.sql import functions as F

    from sparkmend.plans.master import merge_master
    t = _standins(spark, sf_dir)
    master = merge_master(t["telemetry"], t["machines"], t["failures"], t["maintenance"], t["errors"])
    both = (master.select(F.lit(1).alias("_m")).unionByName(t["telemetry"].select(F.lit(0).alias("_m"))))
    return both.agg(F.count_if(F.col("_m") == 1).alias("master_rows"),
                    F.count_if(F.col("_m") == 0).alias("telemetry_rows")).withColumn(
        "rows_match", F.col("master_rows") == F.col("telemetry_rows"))


# ---------------------------------------------------------------------------
# Gates (A27-A30, A32)

def _rule_sql(dataset: str, order: int, rule: str, violations: str, enforced: bool) -> str:
    e = "TRUE" if enforced else "FALSE"
    return (f"SELECT '{dataset}' AS dataset, CAST({order} AS INTEGER) AS rule_order, '{rule}' AS rule, "
            f"CAST(({violations}) AS BIGINT) AS violations, {e} AS enforced, "
            f"CAST(({violations}) AS BIGINT) = 0 AS passed")


def _raw_gate_sql() -> str:
    parts = []
    cats = {"errors": ("errorID", ["error1", "error2", "error3", "error4", "error5"]),
            "failures": ("failure", ["comp1", "comp2", "comp3", "comp4"]),
            "maintenance": ("comp", ["comp1", "comp2", "comp3", "comp4"])}
    for ti, name in enumerate(["telemetry", "errors", "failures", "machines", "maintenance"]):
        base = (ti + 1) * 100
        cols = _AUDIT_TABLES[name]
        parts.append(_rule_sql(name, base + 1, "file_exists", "0", True))
        parts.append(_rule_sql(name, base + 2, "columns_match", "0", True))
        parts.append(_rule_sql(name, base + 3, "null_cells", f"SELECT {_null_sql(cols)} FROM {name}", True))
        parts.append(_rule_sql(name, base + 4, "duplicate_rows",
                               f"(SELECT count(*) FROM {name}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name}))",
                               True))
        if name == "telemetry":
            parts.append(_rule_sql(name, base + 5, "duplicate_keys",
                                   "SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT count(*) AS n FROM telemetry GROUP BY machineID, datetime)",
                                   True))
        if name in cats:
            c, vals = cats[name]
            lst = ", ".join(f"'{v}'" for v in vals)
            parts.append(_rule_sql(name, base + 7, "unlisted_categories",
                                   f"SELECT count_if({c} IS NOT NULL AND {c} NOT IN ({lst})) FROM {name}", False))
        if name == "machines":
            parts.append(_rule_sql(name, base + 8, "duplicate_machine_ids",
                                   "SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT count(*) AS n FROM machines GROUP BY machineID)",
                                   False))
    return f"WITH {STANDIN_CTES}\n" + "\nUNION ALL\n".join(parts)


@register("raw_gate_report", _raw_gate_sql())
def q_raw_gate_report(spark, sf_dir):
    """The raw gate's report over the five contract tables, one row per table and rule."""
    from sparkmend.operators.gates import raw_gate_report
    return raw_gate_report(spark, _standins(spark, sf_dir))


def _merged_gate_sql() -> str:
    sensors = ["volt", "rotate", "pressure", "vibration"]
    parts = [
        _rule_sql("Master_Dataset", 1, "row_count_match",
                  "abs((SELECT count(*) FROM master) - (SELECT count(*) FROM telemetry))", True),
        _rule_sql("Master_Dataset", 2, "duplicate_keys",
                  "SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT count(*) AS n FROM master GROUP BY machineID, datetime)",
                  True),
        _rule_sql("Master_Dataset", 3, "required_columns", "0", True),
        _rule_sql("Master_Dataset", 4, "null_sensor_cells",
                  "SELECT " + " + ".join(f"count_if({c} IS NULL) + count_if(isnan({c}))" for c in sensors)
                  + " FROM master", True),
        _rule_sql("Master_Dataset", 5, "null_machine_cells",
                  "SELECT count_if(model IS NULL) + count_if(age IS NULL) FROM master", True),
        _rule_sql("Master_Dataset", 6, "numeric_event_columns", "0", True),
    ]
    return MASTER_WITH + "\n" + "\nUNION ALL\n".join(parts)


@register("merged_gate_report", _merged_gate_sql())
def q_merged_gate_report(spark, sf_dir):
    """The merged gate's report over the master table."""
    from sparkmend.operators.gates import merged_gate_report
    from sparkmend.plans.master import merge_master
    t = _standins(spark, sf_dir)
    master = merge_master(t["telemetry"], t["machines"], t["failures"], t["maintenance"], t["errors"])
    return merged_gate_report(master, t["telemetry"])


# ---------------------------------------------------------------------------
# Sort (A26)

@register("sorted_master", f"""{MASTER_WITH}
SELECT *, row_number() OVER (ORDER BY machineID, datetime) AS row_index FROM master""")
def q_sorted_master(spark, sf_dir):
    """The master in key order with each row's 1-based position."""
    from sparkmend.operators.sort import with_position
    from sparkmend.plans.master import master_from_standins
    return with_position(master_from_standins(spark, sf_dir), ["machineID", "datetime"])


# ---------------------------------------------------------------------------
# Sources and sinks

@register("csv_roundtrip", "SELECT * FROM events")
def q_csv_roundtrip(spark, sf_dir):
    """events -> headered CSV (overwrite) -> text read -> NA tokens -> cast by contract."""
    from sparkmend.contracts import TableContract
    from sparkmend.session import scratch_path
    from sparkmend.sources.csv import read_typed_csv, write_csv
    from sparkmend.sources.standins import table
    ev = table(spark, sf_dir, "events")
    path = scratch_path(spark, "csv-roundtrip")
    write_csv(ev, path)
    return read_typed_csv(spark, path, TableContract("events", ev.schema))


def _na_sql(c: str) -> str:
    from sparkmend.sources.csv import NA_TOKENS
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return f"CASE WHEN {c} IN ({tokens}) THEN NULL ELSE {c} END"


@register("csv_text_exact", f"""
SELECT 'documents' AS tbl, doc_id AS id, CAST(0 AS BIGINT) AS part, {_na_sql('text')} AS text FROM documents
UNION ALL SELECT 'pages', page_id, 0, {_na_sql('html')} FROM pages
UNION ALL SELECT 'conversations', conv_id, turn, {_na_sql('text')} FROM conversations""")
def q_csv_text_exact(spark, sf_dir):
    """Texts with quotes, commas, line breaks and blanks through the CSV sink and back."""
    from pyspark.sql import functions as F

    from sparkmend.session import scratch_path
    from sparkmend.sources.csv import read_text_csv, write_csv
    from sparkmend.sources.standins import table
    out = None
    for name, key, part, text in (("documents", "doc_id", None, "text"), ("pages", "page_id", None, "html"),
                                  ("conversations", "conv_id", "turn", "text")):
        path = scratch_path(spark, f"csv-{name}")
        write_csv(table(spark, sf_dir, name), path)
        back = read_text_csv(spark, path).select(
            F.lit(name).alias("tbl"), F.col(key).cast("long").alias("id"),
            (F.col(part) if part else F.lit(0)).cast("long").alias("part"), F.col(text).alias("text"))
        out = back if out is None else out.unionByName(back)
    return out


@register("csv_long_ids", "SELECT event_id + 9007199254740993 AS long_id, user_id FROM events")
def q_csv_long_ids(spark, sf_dir):
    """Ids beyond 2^53 through the CSV sink and the typed reader: none may change."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from sparkmend.contracts import TableContract
    from sparkmend.session import scratch_path
    from sparkmend.sources.csv import read_typed_csv, write_csv
    from sparkmend.sources.standins import table
    ids = table(spark, sf_dir, "events").select(
        (F.col("event_id") + F.lit(9007199254740993)).alias("long_id"), F.col("user_id").cast("long").alias("user_id"))
    path = scratch_path(spark, "csv-long-ids")
    write_csv(ids, path)
    return read_typed_csv(spark, path, TableContract("ids", T.StructType(
        [T.StructField("long_id", T.LongType()), T.StructField("user_id", T.LongType())])))


@register("onehot_high_cardinality", """
SELECT o_orderstatus, CAST(o_custkey AS VARCHAR) AS category, CAST(count(*) AS DOUBLE) AS count
FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2""")
def q_onehot_high_cardinality(spark, sf_dir):
    """One-hot counts of a column with very many values, as rows: no value reaches the driver."""
    from sparkmend.functions.onehot import category_counts
    from sparkmend.sources.standins import table
    return category_counts(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"])


@register("document_scan", "SELECT * FROM events")
def q_document_scan(spark, sf_dir):
    """events -> appended as JSON-lines documents -> full collection scan, ``_id`` dropped."""
    from pyspark.sql import functions as F

    from sparkmend.session import scratch_path
    from sparkmend.sources.documents import append_documents, read_collection
    from sparkmend.sources.standins import table
    ev = table(spark, sf_dir, "events")
    path = scratch_path(spark, "collection-events")
    append_documents(ev.withColumn("_id", F.concat(F.lit("oid-"), F.col("event_id").cast("string"))),
                     path)
    from pyspark.sql import types as T
    schema = T.StructType(list(ev.schema.fields) + [T.StructField("_id", T.StringType())])
    return read_collection(spark, path, schema)


# ---------------------------------------------------------------------------
# Window features, label, latest status

_SENSORS = ["volt", "rotate", "pressure", "vibration"]
_W = "PARTITION BY machineID ORDER BY datetime"
_HOUR_US = 3_600_000_000


def _trailing_sql(hours: int) -> str:
    return f"({_W} RANGE BETWEEN INTERVAL {hours * _HOUR_US - 1} MICROSECONDS PRECEDING AND CURRENT ROW)"


def _rolling_sql(hours: int) -> str:
    w = _trailing_sql(hours)
    cols = []
    for s in _SENSORS:
        cols += [f"count({s}) OVER {w} AS {s}_count_{hours}h", f"avg({s}) OVER {w} AS {s}_mean_{hours}h",
                 f"stddev_samp({s}) OVER {w} AS {s}_std_{hours}h", f"min({s}) OVER {w} AS {s}_min_{hours}h",
                 f"max({s}) OVER {w} AS {s}_max_{hours}h"]
    return f"{MASTER_WITH}\nSELECT machineID, datetime,\n  " + ",\n  ".join(cols) + "\nFROM master"


def _master(spark, sf_dir):
    from sparkmend.plans.master import master_from_standins
    return master_from_standins(spark, sf_dir)


def _rolling_query(hours: int):
    def q(spark, sf_dir):
        from sparkmend.plans.features import window_features
        return window_features(_master(spark, sf_dir), ["machineID", "datetime"], sensors=_SENSORS,
                               windows_hours=(hours,))
    q.__name__ = f"q_rolling_{hours}h"
    q.__doc__ = f"count / mean / std / min / max of every sensor over the trailing {hours} hours."
    return q


register("rolling_24h", _rolling_sql(24))(_rolling_query(24))
register("rolling_3h", _rolling_sql(3))(_rolling_query(3))


@register("rolling_720h", f"""{MASTER_WITH}
SELECT machineID, datetime, count(volt) OVER w AS volt_count_720h, min(volt) OVER w AS volt_min_720h,
       max(volt) OVER w AS volt_max_720h
FROM master WINDOW w AS {_trailing_sql(720)}""")
def q_rolling_720h(spark, sf_dir):
    """A window longer than a time bucket: 30 days."""
    from sparkmend.plans.features import window_features
    return window_features(_master(spark, sf_dir), ["machineID", "datetime"], sensors=["volt"], windows_hours=(720,),
                           stats=("count", "min", "max"))


def _hour_back_sql(n: int) -> str:
    return (f"({_W} RANGE BETWEEN INTERVAL {(n + 1) * _HOUR_US - 1} MICROSECONDS PRECEDING "
            f"AND INTERVAL {n * _HOUR_US} MICROSECONDS PRECEDING)")


def _lag_sql() -> str:
    cols = []
    for s in _SENSORS:
        cols += [f"last_value({s}) OVER {_hour_back_sql(n)} AS {s}_lag{n}" for n in (1, 3, 24)]
        cols.append(f"{s} - last_value({s}) OVER {_hour_back_sql(1)} AS {s}_diff1")
    return f"{MASTER_WITH}\nSELECT machineID, datetime,\n  " + ",\n  ".join(cols) + "\nFROM master"


@register("lag_features", _lag_sql())
def q_lag_features(spark, sf_dir):
    """Value of each sensor 1, 3 and 24 hours back (NULL if that hour has no row), and the change."""
    from sparkmend.plans.features import window_features
    return window_features(_master(spark, sf_dir), ["machineID", "datetime"], sensors=_SENSORS,
                           lags=(1, 3, 24))


_HISTORY = ["maint_comp1", "maint_comp2", "maint_comp3", "maint_comp4",
            "failure_comp1", "failure_comp2", "failure_comp3", "failure_comp4"]


def _history_sql() -> str:
    run = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = [f"date_diff('microsecond', last_value(CASE WHEN {c} > 0 THEN datetime END IGNORE NULLS) "
            f"OVER {run}, datetime) / {float(_HOUR_US)} AS hours_since_{c}" for c in _HISTORY]
    cols += [f"sum(failure) OVER {run} AS cum_failure"]
    return f"{MASTER_WITH}\nSELECT machineID, datetime,\n  " + ",\n  ".join(cols) + "\nFROM master"


@register("hours_since_maintenance", _history_sql())
def q_hours_since_maintenance(spark, sf_dir):
    """Hours since the last maintenance / failure of each component; running failure count."""
    from sparkmend.plans.features import window_features
    return window_features(_master(spark, sf_dir), ["machineID", "datetime"], history=_HISTORY,
                           cumulative=["failure"])


@register("label_24h", f"""{MASTER_WITH}
SELECT machineID, datetime, failure,
  COALESCE(max(CAST(CASE WHEN failure > 0 THEN 1 ELSE 0 END AS DOUBLE)) OVER ({_W}
    RANGE BETWEEN INTERVAL 1 MICROSECONDS FOLLOWING AND INTERVAL {24 * _HOUR_US} MICROSECONDS FOLLOWING),
    CAST(0 AS DOUBLE)) AS label_24h
FROM master""")
def q_label_24h(spark, sf_dir):
    """1.0 when a failure occurs in the next 24 hours (current row excluded)."""
    from sparkmend.plans.features import window_features
    return window_features(_master(spark, sf_dir), ["machineID", "datetime", "failure"],
                           label_target="failure", horizon_hours=24)


@register("latest_status", f"""{MASTER_WITH}
SELECT machineID, datetime, volt, rotate, pressure, vibration, model, age, failure
FROM master QUALIFY row_number() OVER (PARTITION BY machineID ORDER BY datetime DESC) = 1""")
def q_latest_status(spark, sf_dir):
    """Latest hourly row of every machine (top-1 per group by time)."""
    from sparkmend.plans.features import latest_per_machine
    return latest_per_machine(_master(spark, sf_dir), "machineID", "datetime",
                              ["datetime", "volt", "rotate", "pressure", "vibration", "model", "age",
                               "failure"])


# ---------------------------------------------------------------------------
# Model: assemble, train, evaluate, store, score, retrain

def _staged_master(spark, sf_dir):
    """The master written once, for queries that read it several times."""
    from sparkmend.session import cut_lineage
    return cut_lineage(_master(spark, sf_dir), "master")


def _derived_sql() -> str:
    """All derived columns of the feature table."""
    run = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = []
    for h in (3, 24):
        w = _trailing_sql(h)
        for c in _SENSORS:
            cols += [f"count({c}) OVER {w} AS {c}_count_{h}h", f"avg({c}) OVER {w} AS {c}_mean_{h}h",
                     f"stddev_samp({c}) OVER {w} AS {c}_std_{h}h", f"min({c}) OVER {w} AS {c}_min_{h}h",
                     f"max({c}) OVER {w} AS {c}_max_{h}h"]
    cols.append(f"sum(error_count) OVER {_trailing_sql(24)} AS error_count_24h")
    for c in _SENSORS:
        cols += [f"last_value({c}) OVER {_hour_back_sql(n)} AS {c}_lag{n}" for n in (1, 3, 24)]
        cols.append(f"{c} - last_value({c}) OVER {_hour_back_sql(1)} AS {c}_diff1")
    for c in (*_HISTORY, "error_count"):
        cols.append(f"date_diff('microsecond', last_value(CASE WHEN {c} > 0 THEN datetime END IGNORE NULLS) "
                    f"OVER {run}, datetime) / {float(_HOUR_US)} AS hours_since_{c}")
    cols += [f"sum({c}) OVER {run} AS cum_{c}" for c in ("failure", "error_count")]
    cols.append(f"""COALESCE(max(CAST(CASE WHEN failure > 0 THEN 1 ELSE 0 END AS DOUBLE)) OVER ({_W}
    RANGE BETWEEN INTERVAL 1 MICROSECONDS FOLLOWING AND INTERVAL {24 * _HOUR_US} MICROSECONDS FOLLOWING),
    CAST(0 AS DOUBLE)) AS label_24h""")
    errors = " + ".join(c for c in EVENT_COLS if c.startswith("errorID_"))
    return (f"{MASTER_WITH}, counted AS (SELECT *, {errors} AS error_count FROM master)\n"
            "SELECT machineID, datetime, error_count,\n  " + ",\n  ".join(cols) + "\nFROM counted")


@register("feature_table", _derived_sql())
def q_feature_table(spark, sf_dir):
    """Every derived column of the feature table, and the label."""
    from sparkmend.plans.features import feature_table
    master = _master(spark, sf_dir)
    drop = [c for c in master.columns if c not in ("machineID", "datetime")]
    return feature_table(master).drop(*drop)


_FITTED: dict[tuple[str, str], object] = {}


def _fitted(spark, sf_dir):
    """(training result, path of the stored model): fitted once a session and folder, shared by the queries that need a model."""
    from sparkmend.plans.features import feature_table
    from sparkmend.plans.model import save_model, train
    from sparkmend.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        result, _ = train(feature_table(_staged_master(spark, sf_dir)))
        path = scratch_path(spark, "model")
        save_model(result.model, path)
        _FITTED.clear()
        _FITTED[key] = result, path
    return _FITTED[key]


_CHECKED = "TRUE AS probability_in_range, TRUE AS prediction_is_binary"


def _checked(scored):
    """Keys of scored rows, and whether probability and prediction are in range (values differ between engines)."""
    from pyspark.sql import functions as F
    return scored.select("machineID", "datetime",
                         F.col("failure_probability").between(0.0, 1.0).alias("probability_in_range"),
                         F.col("predicted_failure").isin(0.0, 1.0).alias("prediction_is_binary"))


@register("train_and_score", f"""{MASTER_WITH}
SELECT machineID, datetime, {_CHECKED} FROM master
WHERE datetime >= (SELECT percentile_disc(0.8) WITHIN GROUP (ORDER BY datetime) FROM master)""")
def q_train_and_score(spark, sf_dir):
    """Features -> time split -> GBT -> save -> load -> score the held-out hours -> store -> read back."""
    from sparkmend.plans.model import load_model, read_predictions, score, store_predictions
    from sparkmend.session import scratch_path
    result, model_path = _fitted(spark, sf_dir)
    store = scratch_path(spark, "predictions")
    store_predictions(score(load_model(model_path), result.test), store)
    return _checked(read_predictions(spark, store))


@register("model_roundtrip", f"""{MASTER_WITH}
SELECT count(*) AS scored, CAST(0 AS BIGINT) AS differing FROM master""")
def q_model_roundtrip(spark, sf_dir):
    """Rows whose score by the model in memory differs from that by the stored and loaded model."""
    from pyspark.sql import functions as F

    from sparkmend.plans.model import load_model, score
    result, path = _fitted(spark, sf_dir)
    old = score(result.model, result.features)
    new = score(load_model(path), result.features).toDF("machineID", "datetime", "p2", "y2")
    return old.join(new, ["machineID", "datetime"]).agg(
        F.count("*").alias("scored"),
        F.count_if((F.col("failure_probability") != F.col("p2")) | (F.col("predicted_failure") != F.col("y2"))).alias("differing"))


@register("store_rerun", f"""{MASTER_WITH}
SELECT CAST(datetime AS DATE)::VARCHAR AS day, count(*) AS stored FROM master GROUP BY 1""")
def q_store_rerun(spark, sf_dir):
    """Rows a day in the prediction store after scoring all days, and then the later half of the days once more."""
    from pyspark.sql import functions as F

    from sparkmend.functions.columns import ntz_literal
    from sparkmend.plans.model import read_predictions, score, store_predictions, time_cutoff
    from sparkmend.session import scratch_path
    result, _ = _fitted(spark, sf_dir)
    store = scratch_path(spark, "predictions")
    store_predictions(score(result.model, result.features), store)
    half = time_cutoff(result.features, 0.5).replace(hour=0)
    store_predictions(score(result.model, result.features.where(F.col("datetime") >= ntz_literal(half))), store)
    return read_predictions(spark, store).groupBy(F.date_format("datetime", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("stored"))


@register("latest_health", f"""{MASTER_WITH}
SELECT machineID, max(datetime) AS datetime, {_CHECKED} FROM master GROUP BY machineID""")
def q_latest_health(spark, sf_dir):
    """Score every hour with the trained model; the newest hour per machine is its health status."""
    from sparkmend.plans.model import latest_health
    result, _ = _fitted(spark, sf_dir)
    return _checked(latest_health(result.model, result.features))


@register("retrain_weekly", f"""{MASTER_WITH}
SELECT machineID, datetime, {_CHECKED},
       strftime((SELECT date_trunc('week', max(datetime)) FROM master), '%Y-%m-%d') AS as_of
FROM master WHERE datetime >= (SELECT date_trunc('week', max(datetime)) FROM master)""")
def q_retrain_weekly(spark, sf_dir):
    """Retrain on the trailing window before the last week boundary, then score the week after it."""
    import datetime as dt

    from pyspark.sql import functions as F

    from sparkmend.plans.model import retrain, score
    from sparkmend.plans.states import features_since
    from sparkmend.session import scratch_path
    master = _staged_master(spark, sf_dir)
    last = master.agg(F.max("datetime").alias("m")).first().m
    as_of = dt.datetime.combine(last.date() - dt.timedelta(days=last.weekday()), dt.time())
    res = retrain(master, as_of, model_root=scratch_path(spark, "models"))
    return _checked(score(res.model, features_since(master, as_of))).withColumn("as_of", F.lit(as_of.strftime("%Y-%m-%d")))


@register("store_stream_then_batch", f"""{MASTER_WITH},
half AS (SELECT date_trunc('day', percentile_disc(0.5) WITHIN GROUP (ORDER BY datetime)) AS d FROM master)
SELECT CAST(datetime AS DATE)::VARCHAR AS day, count(*) AS stored, count(DISTINCT (machineID, datetime)) AS machine_hours,
       count(*) FILTER (WHERE datetime >= (SELECT d FROM half)) AS of_the_run
FROM master GROUP BY 1""")
def q_store_stream_then_batch(spark, sf_dir):
    """Rows a day in the store after stream batches wrote all days, a run re-scored the later half, and a batch was replayed."""
    from pyspark.sql import functions as F

    from sparkmend.functions.columns import ntz_literal
    from sparkmend.plans.model import BATCH_RUN, read_predictions, score, store_predictions, time_cutoff
    from sparkmend.session import cut_lineage, scratch_path
    result, _ = _fitted(spark, sf_dir)
    scored = cut_lineage(score(result.model, result.features), "scored")
    store = scratch_path(spark, "predictions")
    batch = scored.withColumn("batch", F.pmod(F.hour("datetime"), F.lit(3)).cast("long"))  # every day in three batches
    store_predictions(batch, store)
    half = time_cutoff(scored, 0.5).replace(hour=0)
    later = scored.where(F.col("datetime") >= ntz_literal(half))
    store_predictions(later, store)
    store_predictions(batch.where("batch = 1"), store)  # replayed after a failure
    store_predictions(later, store)                     # and the run again
    return read_predictions(spark, store).groupBy(F.date_format("datetime", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("stored"), F.countDistinct("machineID", "datetime").alias("machine_hours"),
        F.count_if(F.col("batch") == BATCH_RUN).alias("of_the_run"))


def _areas_sql(score: str, table: str = "labelled") -> str:
    return f"""SELECT '{score}' AS score, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
       round(CAST(sum(n * (2 * pa + p)) AS DOUBLE) / (CAST(2 AS DOUBLE) * sum(p) * sum(n)), 9) AS area_under_roc,
       round(sum(p * ((pa + p) / (pa + p + na + n) + CASE WHEN pa + na > 0 THEN pa / (pa + na) ELSE p / (p + n) END) / 2) / sum(p), 9) AS area_under_pr
FROM (SELECT *, coalesce(sum(p) OVER w, 0) AS pa, coalesce(sum(n) OVER w, 0) AS na FROM (
        SELECT {score} AS s, count(*) FILTER (WHERE label_24h > 0) AS p, count(*) FILTER (WHERE label_24h <= 0) AS n
        FROM {table} WHERE {score} IS NOT NULL GROUP BY 1)
      WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_EVALUATED = ["volt", "pressure", "age"]  # many ties, few, and hardly any


@register("evaluation_metrics", f"""{MASTER_WITH}, labelled AS (SELECT *,
  COALESCE(max(CAST(CASE WHEN failure > 0 THEN 1 ELSE 0 END AS DOUBLE)) OVER ({_W}
    RANGE BETWEEN INTERVAL 1 MICROSECONDS FOLLOWING AND INTERVAL {24 * _HOUR_US} MICROSECONDS FOLLOWING), 0) AS label_24h
  FROM master)
""" + "\nUNION ALL ".join(_areas_sql(c) for c in _EVALUATED))
def q_evaluation_metrics(spark, sf_dir):
    """Areas under the ROC and precision-recall curves of some columns as scores of the 24-hour label, ties included."""
    from pyspark.sql import functions as F

    from sparkmend.operators.ranking import curve_areas
    from sparkmend.plans.features import window_features
    from sparkmend.session import cut_lineage
    rows = cut_lineage(window_features(_master(spark, sf_dir), [*_EVALUATED], label_target="failure", horizon_hours=24), "labelled")
    out = None
    for c in _EVALUATED:
        one = curve_areas(rows, c, "label_24h").select(
            F.lit(c).alias("score"), "positives", "negatives", F.round("area_under_roc", 9).alias("area_under_roc"),
            F.round("area_under_pr", 9).alias("area_under_pr"))
        out = one if out is None else out.unionByName(one)
    return out


@register("training_learns", f"""{MASTER_WITH},
held AS (SELECT * FROM master WHERE datetime >= (SELECT percentile_disc(0.8) WITHIN GROUP (ORDER BY datetime) FROM master))
SELECT count(*) AS held_out, count(*) FILTER (WHERE age >= 12 AND volt > 50) AS positives,
       TRUE AS area_under_roc_above_099, TRUE AS area_under_pr_above_099 FROM held""")
def q_training_learns(spark, sf_dir):
    """Training on a label that follows a rule of two features: the held-out areas show whether the model learned it.

    A random model has areas of about 0.5 and the share of positives, so the SQL's TRUE fails for it.
    """
    from pyspark.sql import functions as F

    from sparkmend.operators.ranking import curve_areas
    from sparkmend.plans.features import feature_table
    from sparkmend.plans.model import LABEL, score, train
    rule = ((F.col("age") >= 12) & (F.col("volt") > 50)).cast("double")
    feats = feature_table(_staged_master(spark, sf_dir)).withColumn(LABEL, rule)
    result, _ = train(feats, max_iter=5, max_depth=3)
    held = result.test.select("machineID", "datetime", LABEL).join(score(result.model, result.test), ["machineID", "datetime"])
    return curve_areas(held, "failure_probability", LABEL).select(
        (F.col("positives") + F.col("negatives")).alias("held_out"), "positives",
        (F.col("area_under_roc") > 0.99).alias("area_under_roc_above_099"), (F.col("area_under_pr") > 0.99).alias("area_under_pr_above_099"))


@register("rescored_days", f"""{MASTER_WITH}
SELECT CAST(datetime AS DATE)::VARCHAR AS day, count(*) AS scored, CAST(0 AS BIGINT) AS differing FROM master
WHERE datetime >= (SELECT date_trunc('day', percentile_disc(0.7) WITHIN GROUP (ORDER BY datetime)) FROM master) GROUP BY 1""")
def q_rescored_days(spark, sf_dir):
    """Days re-scored from their own folders, the look-back and one folder of machine states, against the run over all history."""
    from pyspark.sql import functions as F

    from sparkmend.plans.master import write_master
    from sparkmend.plans.model import load_model, score, score_days, time_cutoff
    from sparkmend.plans.states import write_states
    from sparkmend.session import scratch_path
    result, model_path = _fitted(spark, sf_dir)
    model, master, states = load_model(model_path), scratch_path(spark, "dated-master"), scratch_path(spark, "states")
    write_master(_master(spark, sf_dir), master)
    write_states(spark, master, states)
    first = time_cutoff(result.features, 0.7).date()
    again = score_days(spark, model, master, states, first)
    whole = score(model, result.features).where(F.to_date("datetime") >= F.lit(first)).toDF("machineID", "datetime", "p", "y")
    same = (F.abs(F.col("failure_probability") - F.col("p")) < 1e-9) & (F.col("predicted_failure") == F.col("y"))
    return again.join(whole, ["machineID", "datetime"], "full").groupBy(F.date_format("datetime", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("scored"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))


# ---------------------------------------------------------------------------
# Hourly streaming

@register("hourly_stream", f"""{MASTER_WITH}
SELECT * FROM master
WHERE datetime + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def q_hourly_stream(spark, sf_dir):
    """events files as a stream -> hourly master rows (1-hour windows, 1-hour watermark, append).

    Only hours the watermark has closed are emitted, so the last open hours of
    the input are absent, exactly as in a live run; every closed hour equals the
    batch master's row.
    """
    from sparkmend.session import scratch_path
    from sparkmend.sources.standins import machines
    from sparkmend.streaming.hourly import run_hourly_master
    out, ck = scratch_path(spark, "hourly-out"), scratch_path(spark, "hourly-ckpt")
    q = run_hourly_master(spark, sf_dir, machines(spark, sf_dir), out, ck, file_glob="events.parquet")
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_scores", f"""{MASTER_WITH}
SELECT count(*) AS scored, CAST(0 AS BIGINT) AS differing FROM master
WHERE datetime + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def q_stream_scores(spark, sf_dir):
    """Events as a stream of several micro-batches -> closed hours -> scores, against a batch run over all history."""
    from pyspark.sql import functions as F

    from sparkmend.plans.model import read_predictions, score
    from sparkmend.session import scratch_path
    from sparkmend.sources.standins import machines, table
    from sparkmend.streaming.hourly import event_quarters, run_hourly_scoring
    result, model_path = _fitted(spark, sf_dir)
    events, quarters = table(spark, sf_dir, "events"), scratch_path(spark, "event-files")
    store, history, ck = (scratch_path(spark, n) for n in ("predictions", "history", "ckpt"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for i, (a, b) in enumerate(event_quarters(events)):  # the quarters arrive one after the other, each in many files
        part = events if a is None else events.where(at >= a)
        (part if b is None else part.where(at < b)).write.parquet(f"{quarters}/part={i}")
        # all files of an arrival in one micro-batch: a later one would find their hours closed
        run_hourly_scoring(spark, f"{quarters}/*", history, model_path, store, ck, machines(spark, sf_dir), max_files_per_trigger=None).awaitTermination()
    whole = score(result.model, result.features).toDF("machineID", "datetime", "p", "y")
    return read_predictions(spark, store).join(whole, ["machineID", "datetime"], "left").agg(
        F.count("*").alias("scored"),
        F.count_if(~F.coalesce((F.abs(F.col("failure_probability") - F.col("p")) < 1e-9) & (F.col("predicted_failure") == F.col("y")), F.lit(False))).alias("differing"))


# ---------------------------------------------------------------------------
# Whole stages (A04-A09, A26, A30-A34): the event tables hold exact duplicate rows,
# which the raw gate rejects, so the stages run on their distinct rows.

DISTINCT_CTES = (STANDIN_CTES
                 .replace("errors AS (\n  SELECT ", "errors AS (\n  SELECT DISTINCT ")
                 .replace("failures AS (\n  SELECT ", "failures AS (\n  SELECT DISTINCT ")
                 .replace("maintenance AS (\n  SELECT ", "maintenance AS (\n  SELECT DISTINCT "))
DISTINCT_MASTER_WITH = f"WITH {DISTINCT_CTES},{ONEHOT_CTES},{MASTER_CTE}"


def _gate_ready_tables(spark, sf_dir):
    t = _standins(spark, sf_dir)
    for name in ("errors", "failures", "maintenance"):
        t[name] = t[name].distinct()
    return t


@register("validation_stage", f"{DISTINCT_MASTER_WITH}\nSELECT * FROM master")
def q_validation_stage(spark, sf_dir):
    """Raw CSV tables -> raw gate -> merge -> merged gate -> sorted master sink -> read back."""
    from sparkmend.plans.master import read_master
    from sparkmend.plans.validation import run_validation
    from sparkmend.session import scratch_path
    from sparkmend.sources.csv import write_csv
    raw = scratch_path(spark, "raw-data")
    for name, df in _gate_ready_tables(spark, sf_dir).items():
        write_csv(df, f"{raw}/{name}.csv")
    art = run_validation(spark, raw, scratch_path(spark, "validation"))
    return read_master(spark, art.merged_data_path)


@register("ingest_then_validate", f"{DISTINCT_MASTER_WITH}\nSELECT * FROM master")
def q_ingest_then_validate(spark, sf_dir):
    """Bulk load into collections -> stage 1 (collections -> raw CSV) -> stage 2 (validation)."""
    from sparkmend.plans.master import read_master
    from sparkmend.plans.validation import run_stages
    from sparkmend.session import scratch_path
    from sparkmend.sources.documents import append_documents
    root = scratch_path(spark, "collections")
    for name, df in _gate_ready_tables(spark, sf_dir).items():
        append_documents(df, f"{root}/{name}")
    res = run_stages(spark, root, scratch_path(spark, "work"))
    return read_master(spark, res.validation.merged_data_path)


# ---------------------------------------------------------------------------
# Tables that break the rules (A05, A08, A09, A10, A27-A30): whole driver tables, written with faults that SQL can count

@register("raw_gate_violations", f"""WITH {STANDIN_CTES},
tel AS (SELECT *, row_number() OVER (ORDER BY machineID, datetime) AS r, date_diff('hour', TIMESTAMP '2024-01-01', datetime) AS h FROM telemetry),
ev AS (SELECT *, 1 AS one FROM errors),
dup AS (SELECT count(*) AS n, count(*) - count(DISTINCT (datetime, machineID, errorID)) AS d FROM errors)
SELECT 'telemetry' AS dataset, 'columns_match' AS rule, CAST(1 AS BIGINT) AS violations
UNION ALL SELECT 'telemetry', 'null_cells', (SELECT count(*) FILTER (WHERE machineID % 7 = 0) + count(*) FILTER (WHERE machineID % 11 = 3) FROM telemetry)
UNION ALL SELECT 'telemetry', 'duplicate_keys', (SELECT count(*) FROM telemetry WHERE machineID % 5 = 1)
UNION ALL SELECT 'telemetry', 'duplicate_rows', 0
UNION ALL SELECT 'telemetry', 'unparseable_values', (SELECT count(*) FROM telemetry WHERE machineID % 13 = 2)
UNION ALL SELECT 'telemetry', 'malformed_rows', (SELECT count(*) FROM telemetry WHERE machineID % 17 = 4)
UNION ALL SELECT 'errors', 'duplicate_rows', (SELECT d FROM dup)
UNION ALL SELECT 'errors', 'unlisted_categories', (SELECT count(*) FROM errors WHERE machineID % 3 = 0)
UNION ALL SELECT 'errors', 'mixed_datetimes', (SELECT least(count(*) FILTER (WHERE machineID % 4 = 0), count(*) FILTER (WHERE machineID % 4 <> 0)) FROM errors)
UNION ALL SELECT 'failures', 'file_exists', 1
UNION ALL SELECT 'machines', 'duplicate_machine_ids', (SELECT count(*) FROM machines WHERE machineID % 10 = 0)
UNION ALL SELECT 'maintenance', 'columns_match', 1""")
def q_raw_gate_violations(spark, sf_dir):
    """The raw gate over CSV tables with a reordered header, missing, unparseable and surplus cells, repeated keys and rows, mixed
    datetime forms, unlisted categories, an extra column and a missing table: the violations of the rules that these faults break."""
    from pyspark.sql import functions as F

    from sparkmend.operators.gates import raw_gate_report
    from sparkmend.plans.validation import read_raw_inputs
    from sparkmend.session import scratch_path
    t, raw = _standins(spark, sf_dir), scratch_path(spark, "broken")
    at = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
    m = F.col("machineID")

    def cells(*values):
        return F.concat_ws(",", *[v.cast("string") if not isinstance(v, str) else F.col(v).cast("string") for v in values]).alias("line")

    def file(df, name, header):
        one = df.sparkSession.createDataFrame([(header,)], "value string")
        # a single file: the header, then the lines
        one.withColumn("o", F.lit(0)).unionByName(df.select(F.col("line").alias("value"), F.lit(1).alias("o"))).coalesce(1) \
            .sortWithinPartitions("o").select("value").write.mode("append").text(f"{raw}/{name}.csv")

    tel = t["telemetry"]
    volt = F.when(m % 13 == 2, F.lit("abc")).otherwise(F.col("volt").cast("string"))
    rotate = F.when(m % 7 == 0, F.lit("NA")).otherwise(F.col("rotate").cast("string"))
    pressure = F.when(m % 11 == 3, F.lit("")).otherwise(F.col("pressure").cast("string"))
    vibration = F.when(m % 17 == 4, F.concat(F.col("vibration").cast("string"), F.lit(",,"))).otherwise(F.col("vibration").cast("string"))
    file(tel.select(cells(at, m, volt, rotate, pressure, vibration)), "telemetry", "datetime,machineID,volt,rotate,pressure,vibration")
    # some keys once more with other sensor values, in a file of another column order
    file(tel.where(m % 5 == 1).select(cells(m, at, F.lit(-1), F.lit(-2), F.lit(-3), F.lit(-4))), "telemetry",
         "machineID,datetime,vibration,pressure,rotate,volt")
    e = t["errors"]
    kind = F.when(m % 3 == 0, F.concat(F.lit("new "), "errorID")).otherwise(F.col("errorID"))
    mixed = F.when(m % 4 == 0, F.date_format("datetime", "MM/dd/yyyy HH:mm:ss")).otherwise(at)
    file(e.select(cells(mixed, m, kind)), "errors", "datetime,machineID,errorID")
    mach = t["machines"]
    file(mach.unionByName(mach.where(m % 10 == 0).withColumn("age", F.col("age") + 100)).select(cells(m, "model", "age")), "machines", "machineID,model,age")
    file(t["maintenance"].select(cells(at, m, "comp", F.lit("x"))), "maintenance", "datetime,machineID,comp,note")
    report = raw_gate_report(spark, read_raw_inputs(spark, raw))
    broken = {"telemetry": ["columns_match", "null_cells", "duplicate_keys", "duplicate_rows", "unparseable_values", "malformed_rows"],
              "errors": ["duplicate_rows", "unlisted_categories", "mixed_datetimes"], "failures": ["file_exists"],
              "machines": ["duplicate_machine_ids"], "maintenance": ["columns_match"]}
    wanted = [F.col("dataset").eqNullSafe(d) & F.col("rule").isin(rules) for d, rules in broken.items()]
    keep = wanted[0]
    for w in wanted[1:]:
        keep = keep | w
    return report.where(keep).select("dataset", "rule", "violations")


_DATETIME_TEXTS = {"seconds": "yyyy-MM-dd HH:mm:ss", "minutes": "yyyy-MM-dd'T'HH:mm", "month_first": "M/d/yyyy H:mm:ss",
                   "day_first": "d/M/yyyy H:mm:ss", "named": "d MMM yyyy HH:mm:ss"}


@register("datetime_forms", "\nUNION ALL ".join(
    [f"SELECT '{n}' AS texts, count(*) AS present, CAST(0 AS BIGINT) AS other, CAST(count(DISTINCT {cut}) AS BIGINT) AS moments, "
     f"max({cut}) AS latest FROM events" for n, cut in ((n, f"date_trunc('{'minute' if n == 'minutes' else 'second'}', ts)") for n in _DATETIME_TEXTS)]
    + ["""SELECT 'mixed', count(*), least(count(*) FILTER (WHERE event_id % 3 = 0), count(*) FILTER (WHERE event_id % 3 <> 0)),
    CAST(count(DISTINCT date_trunc('second', ts)) FILTER (WHERE event_id % 3 <> 0) AS BIGINT), max(date_trunc('second', ts)) FILTER (WHERE event_id % 3 <> 0) FROM events"""]))
def q_datetime_forms(spark, sf_dir):
    """The event times as text in one form a column, and in two forms in one: values of the column's form, others, and what they parse to."""
    from pyspark.sql import functions as F

    from sparkmend.functions.columns import datetime_votes, parse_datetime_as
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    two = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    columns = {**{n: F.date_format("ts", p) for n, p in _DATETIME_TEXTS.items()}, "mixed": two}
    out = None
    for name, text in columns.items():
        rows = events.select(text.alias("datetime"))
        vote = datetime_votes(rows).first()  # one row
        parsed = rows.select(parse_datetime_as("datetime", vote.form, strict=False).alias("t")).agg(
            F.countDistinct("t").alias("moments"), F.max("t").alias("latest"))
        one = parsed.select(F.lit(name).alias("texts"), F.lit(vote.present).cast("long").alias("present"),
                            F.lit(vote.other).cast("long").alias("other"), "moments", "latest")
        out = one if out is None else out.unionByName(one)
    return out


@register("csv_mixed_files", """SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN props || chr(10) || '"' || event_type || '", ' || user_id
       ELSE props END AS note, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS kind FROM events""")
def q_csv_mixed_files(spark, sf_dir):
    """Events as CSV files with line breaks and quotes in values, other column orders and a missing column, read back by their own headers."""
    from pyspark.sql import functions as F

    from sparkmend.session import scratch_path
    from sparkmend.sources.csv import read_text_csv, write_csv
    ev, path = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch_path(spark, "mixed-csv")
    broken = F.concat(F.col("props"), F.lit("\n\""), F.col("event_type"), F.lit('", '), F.col("user_id").cast("string"))
    rows = ev.select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, broken).otherwise(F.col("props")).alias("note"), F.col("event_type").alias("kind"))
    orders = {0: ["event_id", "user_id", "note", "kind"], 1: ["kind", "note", "event_id", "user_id"], 4: ["user_id", "event_id", "note"]}
    for k in range(5):
        write_csv(rows.where(F.col("event_id") % 5 == k).select(*orders.get(k, orders[0])), path, mode="append")
    back = read_text_csv(spark, path)
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "note", "kind")


@register("stage_status", f"""WITH {STANDIN_CTES},
dups AS (
  SELECT CASE WHEN (SELECT count(*) - count(DISTINCT (datetime, machineID, errorID)) FROM errors) > 0 THEN 'errors'
              WHEN (SELECT count(*) - count(DISTINCT (datetime, machineID, failure)) FROM failures) > 0 THEN 'failures'
              WHEN (SELECT count(*) - count(DISTINCT (datetime, machineID, comp)) FROM maintenance) > 0 THEN 'maintenance' END AS d)
SELECT 'distinct' AS tables, 'Validation status: True' AS status, (SELECT count(*) FROM telemetry) AS master_rows, CAST(NULL AS VARCHAR) AS error
UNION ALL SELECT 'as they are', CASE WHEN d IS NULL THEN 'Validation status: True' ELSE 'Validation status: False' END,
       CASE WHEN d IS NULL THEN (SELECT count(*) FROM telemetry) END, 'GateError: table ' || d || ': some rows occur more than once' FROM dups
UNION ALL SELECT 'no machines', 'Validation status: False', NULL, 'FileNotFoundError: no file for table machines'""")
def q_stage_status(spark, sf_dir):
    """Status text and published outputs of the validation stage over clean tables, tables with repeated rows and a missing table."""
    from pyspark.sql import functions as F

    from sparkmend.operators.gates import GateError
    from sparkmend.plans.master import read_master
    from sparkmend.plans.validation import published, run_validation
    from sparkmend.session import scratch_path
    from sparkmend.sources.csv import write_csv
    cases = {"distinct": _gate_ready_tables(spark, sf_dir), "as they are": _standins(spark, sf_dir)}
    cases["no machines"] = {n: df for n, df in cases["distinct"].items() if n != "machines"}
    out = None
    for name, tables in cases.items():
        raw, target = scratch_path(spark, "raw-data"), scratch_path(spark, "validation")
        for table, df in tables.items():
            write_csv(df, f"{raw}/{table}.csv")
        try:
            run_validation(spark, raw, target, csv_copy=False)
        except (GateError, FileNotFoundError):
            pass  # the outcome is what was published
        last = published(spark, target)
        rows = read_master(spark, last.master).count() if last.master else None
        error = last.error and last.error.split(" at ")[0]
        one = spark.read.text(f"{target}/status").select(
            F.lit(name).alias("tables"), F.col("value").alias("status"), F.lit(rows).cast("long").alias("master_rows"),
            F.lit(error).cast("string").alias("error"))
        out = one if out is None else out.unionByName(one)
    return out

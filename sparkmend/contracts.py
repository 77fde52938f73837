"""Table contracts: declared columns, order, types and keys of every table.

The raw tables arrive as text; their contract is the column list and order
(checked) plus a target type (used to parse, and optionally checked).
The master table has a pinned schema: one double column per declared category,
so the output schema does not depend on which categories happen to occur.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference contract for the same results.
# Raw tables in declaration order (the raw gate walks them in this order).
RAW_TABLE_ORDER = ["telemetry", "errors", "failures", "machines", "maintenance"]
# Sensor columns of telemetry and the machine metadata columns.
SENSOR_COLUMNS = ["volt", "rotate", "pressure", "vibration"]
MACHINE_COLUMNS = ["model", "age"]
# Key of the hourly series.
KEY_COLUMNS = ["machineID", "datetime"]
# Declared categories of the sparse event tables.
FAILURE_CATEGORIES = ["comp1", "comp2", "comp3", "comp4"]
MAINTENANCE_CATEGORIES = ["comp1", "comp2", "comp3", "comp4"]
ERROR_CATEGORIES = ["error1", "error2", "error3", "error4", "error5"]
# Output prefixes of the one-hot counts and the target column.
FAILURE_PREFIX = "failure"
MAINTENANCE_PREFIX = "maint"
ERROR_PREFIX = "errorID"
TARGET_COLUMN = "failure"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TableContract:
    """Columns in order with their Spark types, plus the unique key if any."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    categorical: str | None = None
    categories: tuple[str, ...] = field(default_factory=tuple)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def text_schema(self) -> T.StructType:
        """Same columns, all strings: how the raw files are read."""
        return T.StructType([T.StructField(f.name, T.StringType(), True) for f in self.schema])


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


TS = T.TimestampNTZType()
LONG = T.LongType()
DOUBLE = T.DoubleType()
STRING = T.StringType()

TELEMETRY = TableContract(
    "telemetry",
    _schema(("datetime", TS), ("machineID", LONG), ("volt", DOUBLE), ("rotate", DOUBLE),
            ("pressure", DOUBLE), ("vibration", DOUBLE)),
    key=("machineID", "datetime"),
)
ERRORS = TableContract(
    "errors", _schema(("datetime", TS), ("machineID", LONG), ("errorID", STRING)),
    categorical="errorID", categories=tuple(ERROR_CATEGORIES),
)
FAILURES = TableContract(
    "failures", _schema(("datetime", TS), ("machineID", LONG), ("failure", STRING)),
    categorical="failure", categories=tuple(FAILURE_CATEGORIES),
)
MACHINES = TableContract(
    "machines", _schema(("machineID", LONG), ("model", STRING), ("age", LONG)),
    key=("machineID",),
)
MAINTENANCE = TableContract(
    "maintenance", _schema(("datetime", TS), ("machineID", LONG), ("comp", STRING)),
    categorical="comp", categories=tuple(MAINTENANCE_CATEGORIES),
)

RAW_CONTRACTS: dict[str, TableContract] = {
    c.name: c for c in (TELEMETRY, ERRORS, FAILURES, MACHINES, MAINTENANCE)
}
assert list(RAW_CONTRACTS) == RAW_TABLE_ORDER


def onehot_names(prefix: str, categories: list[str] | tuple[str, ...]) -> list[str]:
    return [f"{prefix}_{c}" for c in categories]


FAILURE_COUNT_COLUMNS = onehot_names(FAILURE_PREFIX, FAILURE_CATEGORIES)
MAINTENANCE_COUNT_COLUMNS = onehot_names(MAINTENANCE_PREFIX, MAINTENANCE_CATEGORIES)
ERROR_COUNT_COLUMNS = onehot_names(ERROR_PREFIX, ERROR_CATEGORIES)
EVENT_COLUMNS = (FAILURE_COUNT_COLUMNS + [TARGET_COLUMN] + MAINTENANCE_COUNT_COLUMNS
                 + ERROR_COUNT_COLUMNS)

MASTER = TableContract(
    "Master_Dataset",
    _schema(("datetime", TS), ("machineID", LONG), ("volt", DOUBLE), ("rotate", DOUBLE),
            ("pressure", DOUBLE), ("vibration", DOUBLE), ("model", STRING), ("age", LONG),
            *[(c, DOUBLE) for c in EVENT_COLUMNS]),
    key=("machineID", "datetime"),
)
MASTER_COLUMNS = MASTER.columns


def raw_contracts() -> dict[str, TableContract]:
    """The raw-table entries of the registry; the master entry is not a raw table."""
    return dict(RAW_CONTRACTS)


# Declared pandas dtypes and the Spark type each one is read as.
DTYPE_TO_SPARK = {"int64": LONG, "float64": DOUBLE, "object": STRING, "bool": T.BooleanType(),
                  "datetime64[ns]": TS}
MASTER_KEY = "Master_Dataset"


def load_contracts(path: str, timestamp_columns: tuple[str, ...] = ("datetime",)
                   ) -> tuple[dict[str, TableContract], TableContract | None, str | None]:
    """Read a schema file (``<table>: {columns: {name: dtype}}``) into contracts.

    Returns (raw-table contracts in file order, master contract or None, target
    column or None). The master entry is not a raw table; its ``target_column``
    sits inside it. Columns named in ``timestamp_columns`` are text in the raw
    files and parsed as timestamps, so they are typed ``timestamp_ntz``.
    """
    import yaml

    with open(path) as fh:
        spec = yaml.safe_load(fh) or {}
    raw: dict[str, TableContract] = {}
    master = None
    target = spec.get("target_column")
    for name, body in spec.items():
        if not isinstance(body, dict) or "columns" not in body:
            continue
        fields = []
        for col, dtype in body["columns"].items():
            t = TS if col in timestamp_columns else DTYPE_TO_SPARK.get(str(dtype), STRING)
            fields.append(T.StructField(col, t, True))
        schema = T.StructType(fields)
        if name == MASTER_KEY:
            master = TableContract(name, schema, key=tuple(k for k in KEY_COLUMNS if k in schema.names))
            target = body.get("target_column", target)
            continue
        known = RAW_CONTRACTS.get(name)
        raw[name] = TableContract(name, schema, key=known.key if known else (),
                                  categorical=known.categorical if known else None,
                                  categories=known.categories if known else ())
    return raw, master, target

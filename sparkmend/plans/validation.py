"""The validation stage, and ingestion followed by validation.

Stage 2 (validation): raw gate -> merge -> merged gate -> sinks -> artifact.
The raw text is parsed once and landed as Parquet in the shared checkpoint folder; the raw gate runs over all tables in one job. The merged table
is written into the run's own folder (with its row count observed during that write), the
merged gate runs over the written rows with the telemetry row count taken from
the raw gate, and only a run that passes is published by its manifest. A failure publishes the status ``False`` before
re-raising.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkmend import contracts as C
from sparkmend.functions.columns import datetime_votes
from sparkmend.operators import gates
from sparkmend.operators.sort import partitions_for, total_sort
from sparkmend.plans.master import merge_master, read_master, write_master
from sparkmend.session import cut_lineage
from sparkmend.sources.csv import cast_to_contract, try_read_csv_table, write_csv
from sparkmend.sources.documents import ingest


@dataclass(frozen=True)
class ValidationArtifact:
    validation_status: bool
    validation_report_path: str
    merged_data_path: str
    report_path: str


def read_raw_inputs(spark: SparkSession, raw_data_dir: str,
                    contracts: dict[str, C.TableContract] | None = None, land: bool = False) -> list[gates.RawInput]:
    """Every contract table as text from ``<raw_data_dir>/<name>.csv`` (None when missing), with its headers and datetime form.

    ``land``: write the parsed text once as Parquet into the checkpoint folder, so that gate and merge don't parse the files again.
    """
    out = []
    for name in (contracts or C.RAW_CONTRACTS):
        path = f"{raw_data_dir.rstrip('/')}/{name}.csv"
        t = try_read_csv_table(spark, path, mark_malformed=True)
        df = t and (cut_lineage(t.df, f"raw-{name}") if land and t.df.columns else t.df)
        out.append(gates.RawInput(name, df, path, t.headers if t else ()))
    return with_datetime_forms(spark, out)


def with_datetime_forms(spark: SparkSession, inputs: list[gates.RawInput]) -> list[gates.RawInput]:
    """The inputs with the form of their datetime column: one job for all tables, one row a table."""
    timed = [i for i in inputs if i.df is not None and dict(i.df.dtypes).get("datetime") == "string"]
    votes = [datetime_votes(i.df).withColumn("name", F.lit(i.name)) for i in timed]
    if not votes:
        return inputs
    all_votes = votes[0]
    for v in votes[1:]:
        all_votes = all_votes.unionByName(v)
    found = {r["name"]: r for r in all_votes.collect()}
    return [replace(i, datetime_form=found[i.name].form, other_datetimes=found[i.name].other) if i.name in found else i for i in inputs]


def typed_tables(inputs: list[gates.RawInput],
                 contracts: dict[str, C.TableContract] | None = None) -> dict[str, DataFrame]:
    """Cast each raw table to its contract (timestamps strict: text that doesn't have the column's form raises)."""
    contracts = contracts or C.RAW_CONTRACTS
    return {i.name: cast_to_contract(i.df, contracts[i.name], datetime_form=i.datetime_form) for i in inputs}


def validate_raw(spark: SparkSession, inputs: list[gates.RawInput], strict: bool = False,
                 contracts: dict[str, C.TableContract] | None = None
                 ) -> tuple[list, dict[str, int | None]]:
    """Run the raw gate; returns (report rows, rows per table), raises on the first failed rule."""
    report = gates.raw_gate_report(spark, inputs, contracts, strict=strict, with_rows=True)
    collected = sorted(report.collect(), key=lambda r: r.rule_order)
    table_rows = {r.dataset: r.rows for r in collected}
    rows = [gates.REPORT_ROW(*[r[f] for f in gates.REPORT_SCHEMA.fieldNames()]) for r in collected]
    gates.enforce(rows, gates.raw_details(inputs, contracts))
    return rows, table_rows


def _write_status(spark: SparkSession, path: str, status: bool) -> None:
    (spark.createDataFrame([(f"Validation status: {status}",)], "value string")
     .coalesce(1).write.mode("overwrite").text(path))


MANIFEST_SCHEMA = "run string, validation_status boolean, master string, master_csv string, report string, error string"


@dataclass(frozen=True)
class Published:
    """What the last run of the stage left: its status, and the outputs if it passed."""

    run: str
    validation_status: bool
    master: str | None
    master_csv: str | None
    report: str | None
    error: str | None


def published(spark: SparkSession, out_dir: str) -> Published | None:
    """The last run's entry; None when no run has ended there. Readers take the outputs' paths from it."""
    try:
        row = spark.read.schema(MANIFEST_SCHEMA).json(f"{out_dir.rstrip('/')}/manifest").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise
    return row and Published(**row.asDict())


def _publish(spark: SparkSession, out: str, entry: Published) -> None:
    _write_status(spark, f"{out}/status", entry.validation_status)
    row = tuple(getattr(entry, f.name) for f in fields(Published))
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{out}/manifest")


def run_validation(spark: SparkSession, raw_data_dir: str, out_dir: str, strict: bool = False,
                   csv_copy: bool = True, contracts: dict[str, C.TableContract] | None = None
                   ) -> ValidationArtifact:
    """Full stage 2. Every run writes ``master`` (Parquet, ``date=`` folders in key order), optionally ``master_csv``, and ``report``
    (JSON rows of both gates) into a folder of its own, ``<out_dir>/runs/<run>``. After the last check and write the run is
    published: ``<out_dir>/status`` (text) and ``<out_dir>/manifest``, which names the outputs. A run that fails anywhere publishes the
    status ``False`` and no outputs, so a table that it wrote halfway is never read."""
    out, run = out_dir.rstrip("/"), uuid.uuid4().hex[:12]
    base = f"{out}/runs/{run}"
    master_path, csv_path, report_path = f"{base}/master", f"{base}/master_csv", f"{base}/report"
    try:
        inputs = read_raw_inputs(spark, raw_data_dir, contracts, land=True)
        raw_rows, table_rows = validate_raw(spark, inputs, strict, contracts)
        typed = typed_tables(inputs, contracts)
        master = merge_master(typed["telemetry"], typed["machines"], typed["failures"],
                              typed["maintenance"], typed["errors"])
        # the raw gate counted the telemetry rows already: no second scan of its file
        tel_rows = table_rows["telemetry"]
        obs = Observation("master_rows")
        write_master(master.observe(obs, F.count(F.lit(1)).alias("rows")), master_path, rows=tel_rows)
        written = read_master(spark, master_path)
        merged = gates.merged_gate_report(written, tel_rows)
        merged_rows = sorted(merged.collect(), key=lambda r: r.rule_order)
        master_rows = obs.get["rows"]
        gates.enforce(merged_rows, gates.merged_details(written, master_rows, tel_rows))
        if csv_copy:
            write_csv(total_sort(written, C.KEY_COLUMNS, partitions_for(master_rows, written)), csv_path)
        (spark.createDataFrame(raw_rows + merged_rows, gates.REPORT_SCHEMA).coalesce(1)
         .write.mode("overwrite").json(report_path))
        _publish(spark, out, Published(run, True, master_path, csv_path if csv_copy else None, report_path, None))
        return ValidationArtifact(True, f"{out}/status", master_path, report_path)
    except Exception as e:
        _publish(spark, out, Published(run, False, None, None, None, f"{type(e).__name__}: {e}"[:2000]))
        raise


@dataclass(frozen=True)
class StagesResult:
    raw_data_dir: str
    validation: ValidationArtifact | None
    halted: bool


def run_stages(spark: SparkSession, collections_root: str, work_dir: str,
                 strict: bool = False, collections: list[str] | None = None,
                 raw_data_dir: str | None = None, validation_dir: str | None = None,
                 contracts: dict[str, C.TableContract] | None = None) -> StagesResult:
    """Stage 1 (collections -> raw CSV) then stage 2 (validation); stops when invalid."""
    work = work_dir.rstrip("/")
    ing = ingest(spark, collections_root, raw_data_dir or f"{work}/raw_data", collections)
    art = run_validation(spark, ing.raw_data_dir, validation_dir or f"{work}/validation",
                         strict=strict, contracts=contracts)
    return StagesResult(ing.raw_data_dir, art, halted=not art.validation_status)


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run: collection names and stage folders (relative to the work folder)."""

    collections: list[str]
    raw_data_dir: str
    validation_dir: str


def load_run_config(path: str, work_dir: str) -> RunConfig:
    """Read a run configuration file::

        data_ingestion: {collections: [...], raw_data_dir: ...}
        data_validation: {root_dir: ...}

    Relative folders are taken under ``work_dir``.
    """
    import yaml

    with open(path) as fh:
        cfg = yaml.safe_load(fh) or {}
    ing = cfg.get("data_ingestion", {}) or {}
    val = cfg.get("data_validation", {}) or {}
    work = work_dir.rstrip("/")

    def under(p: str | None, default: str) -> str:
        p = p or default
        return p if "://" in p or p.startswith("/") else f"{work}/{p}"

    return RunConfig(list(ing.get("collections") or C.RAW_TABLE_ORDER),
                     under(ing.get("raw_data_dir"), "raw_data"),
                     under(val.get("root_dir"), "validation"))

"""Schema files in the reference's format, and the command-line jobs."""

import json
import os

import yaml

from fixtures import write_all
from sparkmend import contracts as C
from sparkmend.__main__ import main

PANDAS_NAMES = {"timestamp_ntz": "object", "string": "object", "bigint": "int64", "double": "float64"}


def _table(contract):
    return {"columns": {f.name: PANDAS_NAMES[f.dataType.simpleString()] for f in contract.schema.fields}}


def schema_text(names):
    """A schema file for some tables and a small master, from the contracts."""
    master = {"columns": {"datetime": "datetime64[ns]", "machineID": "int64", "failure": "float64"}, "target_column": "failure"}
    return yaml.safe_dump({**{n: _table(C.RAW_CONTRACTS[n]) for n in names}, "Master_Dataset": master}, sort_keys=False)


SCHEMA = schema_text(["telemetry", "machines"])
SCHEMA_FULL = schema_text(C.RAW_TABLE_ORDER)


def test_load_contracts(tmp_path):
    p = tmp_path / "schema.yaml"
    p.write_text(SCHEMA)
    raw, master, target = C.load_contracts(str(p))
    assert list(raw) == ["telemetry", "machines"]  # the master entry is not a raw table
    assert raw["telemetry"].schema == C.TELEMETRY.schema
    assert raw["machines"].schema == C.MACHINES.schema
    assert master.columns == ["datetime", "machineID", "failure"] and target == "failure"


def test_cli_validate(spark, write_csv, tmp_path, capsys):
    folder = write_all(write_csv)
    out = str(tmp_path / "v")
    assert main(["validate", "--raw-dir", folder, "--out", out]) == 0
    art = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert art["validation_status"] is True and os.path.isdir(art["merged_data_path"])


def test_cli_failed_gate_exits_1(spark, write_csv, tmp_path, capsys):
    from fixtures import TABLES
    folder = write_all(write_csv, {"failures": TABLES["failures"] + "2015-01-01 07:00:00,1,comp1\n"})
    assert main(["validate", "--raw-dir", folder, "--out", str(tmp_path / "v")]) == 1
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["validation_status"] is False and "more than once" in out["error"]


CONFIG = yaml.safe_dump({"data_ingestion": {"collections": C.RAW_TABLE_ORDER, "raw_data_dir": "in/csv"},
                         "data_validation": {"root_dir": "out/checked"}})


def test_cli_run_with_config_and_schema(spark, write_csv, tmp_path, capsys):
    from sparkmend.plans.validation import published
    from sparkmend.sources.csv import read_text_csv
    from sparkmend.sources.documents import append_documents
    folder = write_all(write_csv)
    root = tmp_path / "collections"
    for name in C.RAW_TABLE_ORDER:
        append_documents(read_text_csv(spark, f"{folder}/{name}.csv"), str(root / name))
    (tmp_path / "config.yaml").write_text(CONFIG)
    (tmp_path / "schema.yaml").write_text(SCHEMA_FULL)
    work = tmp_path / "work"
    assert main(["run", "--collections", str(root), "--work", str(work),
                 "--config", str(tmp_path / "config.yaml"), "--schema", str(tmp_path / "schema.yaml")]) == 0
    assert os.path.isdir(work / "in/csv/telemetry.csv")
    assert os.path.isdir(work / "out/checked/runs") and published(spark, str(work / "out/checked")).validation_status


def test_cli_train_score_retrain(spark, tmp_path, capsys):
    from conftest import SF_SMALL
    from sparkmend.plans.master import master_from_standins
    master = str(tmp_path / "master")
    master_from_standins(spark, SF_SMALL).write.parquet(master)
    model = str(tmp_path / "model")
    assert main(["train", "--master", master, "--model", model, "--max-iter", "3"]) == 0
    metrics = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert "areaUnderROC" in metrics and os.path.isdir(model)
    store, latest = str(tmp_path / "store"), str(tmp_path / "latest")
    assert main(["score", "--master", master, "--model", model, "--store", store, "--latest", latest]) == 0
    n_rows = spark.read.parquet(master).count()
    assert spark.read.parquet(store).count() == n_rows
    assert spark.read.parquet(latest).count() == spark.read.parquet(master).select("machineID").distinct().count()
    before = {r.date: r.n for r in spark.read.parquet(store).groupBy("date").count()
              .withColumnRenamed("count", "n").collect()}
    assert main(["score", "--master", master, "--model", model, "--store", store, "--from", "2024-01-25"]) == 0
    after = {r.date: r.n for r in spark.read.parquet(store).groupBy("date").count()
             .withColumnRenamed("count", "n").collect()}
    assert after == before  # the re-scored days were replaced, not appended; the others untouched
    assert main(["retrain", "--master", master, "--as-of", "2024-01-22", "--model-root", str(tmp_path / "m"),
                 "--train-days", "14"]) == 0
    assert os.path.isdir(tmp_path / "m" / "as_of=2024-01-22")
    from sparkmend.sources import standins as S
    machines = str(tmp_path / "machines")
    S.machines(spark, SF_SMALL).write.parquet(machines)
    preds = str(tmp_path / "stream_store")
    assert main(["stream", "--events", SF_SMALL, "--glob", "events.parquet", "--history", str(tmp_path / "h"),
                 "--model", model, "--store", preds, "--checkpoint", str(tmp_path / "ck"),
                 "--machines", machines, "--once"]) == 0
    assert spark.read.parquet(preds).count() > 0

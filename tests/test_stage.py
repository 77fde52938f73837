"""Stage 2 end to end (CSV -> gates -> master -> sinks), stage 1, and both stages in a row."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fixtures import TABLES, write_all
from sparkmend import contracts as C
from sparkmend.operators.gates import GateError
from sparkmend.plans.master import read_master
from sparkmend.plans.validation import published, run_stages, run_validation
from sparkmend.sources.csv import read_text_csv
from sparkmend.sources.documents import append_documents, ingest, read_collection


def _status(path):
    text = "".join(open(f).read() for f in glob.glob(os.path.join(path, "part-*")))
    return text.strip()


def test_validation_stage_writes_sorted_master_and_status(spark, write_csv, tmp_path):
    folder = write_all(write_csv)
    out = str(tmp_path / "validation")
    art = run_validation(spark, folder, out)
    assert art.validation_status is True
    assert _status(art.validation_report_path) == "Validation status: True"
    master = read_master(spark, art.merged_data_path)
    assert master.columns == C.MASTER_COLUMNS and master.count() == 5
    import pyarrow.parquet as pq
    keys = []
    for f in sorted(glob.glob(os.path.join(art.merged_data_path, "date=2015-01-01", "part-*.parquet"))):
        t = pq.ParquetFile(f).read(columns=["machineID", "datetime"]).to_pylist()
        keys += [(r["machineID"], r["datetime"]) for r in t]
    assert len(keys) == 5 and keys == sorted(keys)  # a day's files in name order hold keys in order
    last = published(spark, out)
    assert last.validation_status and last.master == art.merged_data_path
    csv_copy = read_text_csv(spark, last.master_csv)
    assert csv_copy.columns == C.MASTER_COLUMNS and csv_copy.count() == 5
    r = {(x.machineID, x.datetime.hour): x for x in master.collect()}
    assert r[(1, 7)].failure_comp1 == 1.0 and r[(1, 7)].failure == 1.0
    assert r[(1, 6)].maint_comp1 == 1.0 and r[(1, 6)].errorID_error3 == 1.0
    report = spark.read.json(art.report_path)
    assert report.where(~F.col("passed")).count() == 0
    assert report.count() > 20


def test_validation_failure_writes_false_and_raises(spark, write_csv, tmp_path):
    folder = write_all(write_csv, {"failures": TABLES["failures"] + "2015-01-01 07:00:00,1,comp1\n"})
    out = str(tmp_path / "validation")
    with pytest.raises(GateError, match="table failures: some rows occur more than once"):
        run_validation(spark, folder, out)
    assert _status(os.path.join(out, "status")) == "Validation status: False"
    last = published(spark, out)
    assert not last.validation_status and last.master is None and "occur more than once" in last.error


def test_document_scan_drops_id_and_bulk_load_appends(spark, tmp_path):
    path = str(tmp_path / "coll" / "machines")
    df = spark.createDataFrame([("a1", 1, "model3", 18)], "_id string, machineID long, model string, age long")
    append_documents(df, path)
    assert read_collection(spark, path).columns == ["age", "machineID", "model"]
    append_documents(df, path)  # re-running the bulk load duplicates the documents
    assert read_collection(spark, path, C.MACHINES.schema).count() == 2


def test_ingest_then_validate_from_collections(spark, write_csv, tmp_path):
    # stage 0: load the hand-made CSVs into collections, as the bulk loader does
    folder = write_all(write_csv)
    root = str(tmp_path / "collections")
    for name in C.RAW_TABLE_ORDER:
        append_documents(read_text_csv(spark, os.path.join(folder, f"{name}.csv")),
                         f"{root}/{name}")
    res = run_stages(spark, root, str(tmp_path / "work"))
    assert not res.halted and res.validation.validation_status
    assert read_master(spark, res.validation.merged_data_path).count() == 5
    ing = ingest(spark, root, str(tmp_path / "raw2"))
    assert ing.tables == tuple(C.RAW_TABLE_ORDER)
    assert read_text_csv(spark, f"{ing.raw_data_dir}/telemetry.csv").columns == C.TELEMETRY.columns


def test_exported_collection_lines_feed_the_stages(spark, tmp_path):
    """JSON lines as a document-store export writes them: ``_id`` objects, numbers as numbers."""
    root = tmp_path / "export"
    docs = {
        "telemetry": ['{"_id": {"$oid": "a1"}, "datetime": "2015-01-01 06:00:00", "machineID": 1, '
                      '"volt": 176.2, "rotate": 418.5, "pressure": 113.1, "vibration": 45.1}',
                      '{"_id": {"$oid": "a2"}, "datetime": "2015-01-01 07:00:00", "machineID": 1, '
                      '"volt": 162.9, "rotate": 402.7, "pressure": 95.5, "vibration": 43.4}'],
        "errors": ['{"_id": {"$oid": "b1"}, "datetime": "2015-01-01 06:00:00", "machineID": 1, "errorID": "error1"}'],
        "failures": ['{"_id": {"$oid": "c1"}, "datetime": "2015-01-01 07:00:00", "machineID": 1, "failure": "comp2"}'],
        "machines": ['{"_id": {"$oid": "d1"}, "machineID": 1, "model": "model3", "age": 18}'],
        "maintenance": ['{"_id": {"$oid": "e1"}, "datetime": "2015-01-01 06:00:00", "machineID": 1}'],
    }
    for name, lines in docs.items():
        (root / name).mkdir(parents=True)
        (root / name / "part-0.json").write_text("\n".join(lines) + "\n")
    raw = str(tmp_path / "raw")
    ingest(spark, str(root), raw)
    tel = read_text_csv(spark, f"{raw}/telemetry.csv")
    assert tel.columns == C.TELEMETRY.columns
    assert sorted(r.machineID for r in tel.collect()) == ["1", "1"]  # numbers kept as written
    # no maintenance document has `comp`, so the table built from the documents has no
    # such column (only fields that occur are kept) and the column check refuses it
    with pytest.raises(GateError, match="table maintenance: the columns are"):
        run_validation(spark, raw, str(tmp_path / "v"))
    # with the field present in one document only, the other document has a null cell
    (root / "maintenance" / "part-1.json").write_text(
        '{"_id": {"$oid": "e2"}, "datetime": "2015-01-01 07:00:00", "machineID": 1, "comp": "comp2"}\n')
    ingest(spark, str(root), raw)
    with pytest.raises(GateError, match="table maintenance: some cells are missing"):
        run_validation(spark, raw, str(tmp_path / "v2"))


def test_header_only_event_table_passes(spark, write_csv, tmp_path):
    folder = write_all(write_csv, {"errors": "datetime,machineID,errorID\n"})
    art = run_validation(spark, folder, str(tmp_path / "v"))
    master = read_master(spark, art.merged_data_path)
    assert master.count() == 5
    assert master.agg(F.sum("errorID_error1")).first()[0] == 0.0


def test_machine_fan_out_stops_the_stage_with_counts(spark, write_csv, tmp_path):
    folder = write_all(write_csv, {"machines": TABLES["machines"] + "2,model1,9\n"})
    out = str(tmp_path / "v")
    with pytest.raises(GateError, match=r"7 instead of 5"):
        run_validation(spark, folder, out)
    assert _status(os.path.join(out, "status")) == "Validation status: False"


def test_ingest_keeps_undeclared_fields_so_the_gate_sees_them(spark, tmp_path):
    root = tmp_path / "export"
    (root / "machines").mkdir(parents=True)
    (root / "machines" / "part-0.json").write_text(
        '{"_id": {"$oid": "d1"}, "machineID": 1, "model": "model3", "age": 18, "site": "north"}\n'
        '{"_id": {"$oid": "d2"}, "age": 7, "machineID": 2, "model": "model4"}\n')
    raw = str(tmp_path / "raw")
    ingest(spark, str(root), raw, names=["machines"])
    df = read_text_csv(spark, f"{raw}/machines.csv")
    assert df.columns == ["machineID", "model", "age", "site"]  # declared order, then extras
    assert sorted((r.machineID, r.site) for r in df.collect()) == [("1", "north"), ("2", None)]
    ingest(spark, str(root), str(tmp_path / "raw2"), names=["machines"], infer_fields=False)
    assert read_text_csv(spark, f"{tmp_path}/raw2/machines.csv").columns == ["machineID", "model", "age"]


def test_strict_stage_enforces_declared_types(spark, write_csv, tmp_path):
    folder = write_all(write_csv, {"machines": TABLES["machines"].replace("18", "eighteen")})
    # lenient: the raw gate only reports the bad cell; the typed master holds NULL there,
    # so the merged gate stops the run (pandas would have kept the column as text)
    with pytest.raises(GateError, match="missing machine metadata"):
        run_validation(spark, folder, str(tmp_path / "lenient"))
    with pytest.raises(GateError, match="table machines: some values are not of the declared type"):
        run_validation(spark, folder, str(tmp_path / "strict"), strict=True)


def test_failure_after_the_master_is_written_publishes_nothing(spark, write_csv, tmp_path, monkeypatch):
    folder, out = write_all(write_csv), str(tmp_path / "v")
    assert published(spark, out) is None
    first = run_validation(spark, folder, out)
    assert published(spark, out).master == first.merged_data_path

    def fail(*_args, **_kw):
        raise OSError("no space left")

    monkeypatch.setattr("sparkmend.plans.validation.write_csv", fail)
    with pytest.raises(OSError, match="no space left"):
        run_validation(spark, folder, out)
    last = published(spark, out)
    assert not last.validation_status and last.master is None and "no space left" in last.error
    assert _status(os.path.join(out, "status")) == "Validation status: False"

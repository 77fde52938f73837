"""Raw and merged gates: one passing and one violating case per rule (hand-made rows)."""

import pytest

from fixtures import TABLES, write_all
from sparkmend.operators import gates
from sparkmend.plans import validation as V


def _report(spark, folder, strict=False):
    inputs = V.read_raw_inputs(spark, folder)
    rows = gates.raw_gate_report(spark, inputs, strict=strict).collect()
    return inputs, {(r.dataset, r.rule): r for r in rows}


def _failed(rep):
    return sorted((k for k, r in rep.items() if r.passed is False), key=lambda k: rep[k].rule_order)


def test_passing_tables_pass(spark, write_csv):
    folder = write_all(write_csv)
    inputs, rep = _report(spark, folder)
    assert _failed(rep) == []
    assert gates.enforce(gates.raw_gate_report(spark, inputs), gates.raw_details(inputs))


def test_missing_file(spark, write_csv):
    folder = write_all(write_csv, skip=("failures",))
    inputs, rep = _report(spark, folder)
    assert rep[("failures", "file_exists")].violations == 1
    with pytest.raises(FileNotFoundError, match="no file for table failures"):
        V.validate_raw(spark, inputs)


def test_header_reordered(spark, write_csv):
    text = TABLES["machines"].replace("machineID,model,age", "model,machineID,age")
    folder = write_all(write_csv, {"machines": text})
    inputs, rep = _report(spark, folder)
    assert rep[("machines", "columns_match")].passed is False
    with pytest.raises(gates.GateError, match="table machines: the columns are"):
        V.validate_raw(spark, inputs)


def test_extra_column(spark, write_csv):
    lines = TABLES["errors"].strip().split("\n")
    text = "\n".join([lines[0] + ",extra.col"] + [ln + ",x" for ln in lines[1:]]) + "\n"
    inputs, rep = _report(spark, write_all(write_csv, {"errors": text}))
    assert rep[("errors", "columns_match")].violations == 1
    assert rep[("errors", "null_cells")].violations == 0  # a dotted name is a plain column


@pytest.mark.parametrize("token", ["NA", "", "null", "NaN", "n/a", "None", "#N/A"])
def test_na_tokens_in_numeric_and_text(spark, write_csv, token):
    tel = TABLES["telemetry"].replace("176.2", token)
    mach = TABLES["machines"].replace("model3", token)
    inputs, rep = _report(spark, write_all(write_csv, {"telemetry": tel, "machines": mach}))
    assert rep[("telemetry", "null_cells")].violations == 1
    assert rep[("machines", "null_cells")].violations == 1
    with pytest.raises(gates.GateError, match="table telemetry: some cells are missing"):
        V.validate_raw(spark, inputs)


def test_bad_number_is_reported_but_not_enforced(spark, write_csv):
    tel = TABLES["telemetry"].replace("176.2", "abc")
    inputs, rep = _report(spark, write_all(write_csv, {"telemetry": tel}))
    r = rep[("telemetry", "unparseable_values")]
    assert r.violations == 1 and r.enforced is False
    assert rep[("telemetry", "null_cells")].violations == 0  # text is not missing
    V.validate_raw(spark, inputs)  # passes like the reference gate
    _, strict = _report(spark, write_all(write_csv, {"telemetry": tel}), strict=True)
    assert strict[("telemetry", "unparseable_values")].enforced is True


def test_malformed_timestamp_counts_and_merge_raises(spark, write_csv):
    tel = TABLES["telemetry"].replace("2015-01-01 08:00:00,1", "not-a-date,1")
    inputs, rep = _report(spark, write_all(write_csv, {"telemetry": tel}))
    assert rep[("telemetry", "unparseable_values")].violations == 1
    typed = V.typed_tables(inputs)
    with pytest.raises(Exception, match="unparseable datetime"):
        typed["telemetry"].collect()


def test_exact_duplicate_row(spark, write_csv):
    text = TABLES["failures"] + "2015-01-01 07:00:00,1,comp1\n"
    inputs, rep = _report(spark, write_all(write_csv, {"failures": text}))
    assert rep[("failures", "duplicate_rows")].violations == 1
    with pytest.raises(gates.GateError, match="table failures: some rows occur more than once"):
        V.validate_raw(spark, inputs)


def test_duplicate_rows_compare_parsed_values(spark, write_csv):
    # "7" and "7.0" are the same age once parsed, as in a typed reader
    text = TABLES["machines"] + "2,model4,7.0\n"
    _, rep = _report(spark, write_all(write_csv, {"machines": text}))
    assert rep[("machines", "duplicate_rows")].violations == 1


def test_duplicate_telemetry_key(spark, write_csv):
    text = TABLES["telemetry"] + "2015-01-01 06:00:00,1,1.0,2.0,3.0,4.0\n"
    inputs, rep = _report(spark, write_all(write_csv, {"telemetry": text}))
    assert rep[("telemetry", "duplicate_rows")].violations == 0
    assert rep[("telemetry", "duplicate_keys")].violations == 1
    with pytest.raises(gates.GateError, match="table telemetry: a machine has two rows"):
        V.validate_raw(spark, inputs)


def test_unlisted_category_reported(spark, write_csv):
    text = TABLES["errors"] + "2015-01-01 08:00:00,1,error9\n"
    _, rep = _report(spark, write_all(write_csv, {"errors": text}))
    r = rep[("errors", "unlisted_categories")]
    assert r.violations == 1 and r.enforced is False


def test_duplicate_machine_id_reported_and_fans_out(spark, write_csv):
    text = TABLES["machines"] + "2,model1,9\n"
    folder = write_all(write_csv, {"machines": text})
    inputs, rep = _report(spark, folder)
    assert rep[("machines", "duplicate_machine_ids")].violations == 1
    assert rep[("machines", "duplicate_machine_ids")].enforced is False
    V.validate_raw(spark, inputs)  # the reference raw gate lets it through ...
    typed = V.typed_tables(inputs)
    from sparkmend.plans.master import merge_master
    master = merge_master(typed["telemetry"], typed["machines"], typed["failures"],
                          typed["maintenance"], typed["errors"])
    rep2 = {r.rule: r for r in gates.merged_gate_report(master, typed["telemetry"]).collect()}
    assert rep2["row_count_match"].violations == 2  # ... the merge fans out
    assert rep2["duplicate_keys"].violations == 2
    with pytest.raises(gates.GateError, match="the merge changed the number of rows"):
        gates.enforce(gates.merged_gate_report(master, typed["telemetry"]))


def test_machine_absent_gives_null_metadata(spark, write_csv):
    text = "machineID,model,age\n1,model3,18\n"
    inputs, _ = _report(spark, write_all(write_csv, {"machines": text}))
    typed = V.typed_tables(inputs)
    from sparkmend.plans.master import merge_master
    master = merge_master(typed["telemetry"], typed["machines"], typed["failures"],
                          typed["maintenance"], typed["errors"])
    rep = {r.rule: r for r in gates.merged_gate_report(master, typed["telemetry"]).collect()}
    assert rep["null_machine_cells"].violations == 4  # model and age of two rows
    assert rep["row_count_match"].violations == 0
    with pytest.raises(gates.GateError, match="missing machine metadata"):
        gates.enforce(gates.merged_gate_report(master, typed["telemetry"]))


def test_merged_schema_rules(spark):
    df = spark.createDataFrame([(1, "x", "2")], "machineID long, volt string, failure_comp1 string")
    assert gates.non_numeric_event_columns(df) == ["failure_comp1"]
    rep = {r.rule: r for r in gates.merged_gate_report(df, df).collect()}
    assert rep["required_columns"].violations == 5
    assert rep["numeric_event_columns"].violations == 1
    ok = spark.createDataFrame([(1, True, 2.0)], "machineID long, failure boolean, maint_comp1 double")
    assert gates.non_numeric_event_columns(ok) == []  # booleans count as numeric


def test_rows_with_surplus_cells_are_counted(spark, write_csv):
    folder = write_all(write_csv, {"machines": TABLES["machines"] + "3,model1,9,surplus\n4,model2\n"})
    rep = {r.rule: r for r in gates.raw_gate_report(spark, V.read_raw_inputs(spark, folder)).collect() if r.dataset == "machines"}
    assert rep["malformed_rows"].violations == 1 and rep["null_cells"].violations == 1
    assert rep["columns_match"].passed


def test_report_shuffle_carries_hashes_only(spark, write_csv):
    report = gates.raw_gate_report(spark, V.read_raw_inputs(spark, write_all(write_csv, {})))
    plan = report._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert keyed and all("_h0" in line or "_k0" in line for line in keyed)


def test_long_ids_stay_apart(spark, write_csv):
    ids = "datetime,machineID,volt,rotate,pressure,vibration\n" + "".join(
        f"2015-01-01 06:00:00,{i},1,2,3,4\n" for i in (9007199254740992, 9007199254740993))
    rep = {r.rule: r for r in gates.raw_gate_report(spark, V.read_raw_inputs(
        spark, write_all(write_csv, {"telemetry": ids}))).collect() if r.dataset == "telemetry"}
    assert rep["duplicate_rows"].violations == 0 and rep["duplicate_keys"].violations == 0

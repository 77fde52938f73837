"""CSV folders: split reads proved safe, headers of every file, surplus cells; one datetime form a column; exact duplicates."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fixtures import TABLES, write_all
from sparkmend.functions.columns import DATETIME_FORMS, datetime_votes
from sparkmend.operators import audits, gates
from sparkmend.plans import validation as V
from sparkmend.sources.csv import MALFORMED, audit_csv, read_csv_table, read_text_csv


def folder(tmp_path, **files):
    d = tmp_path / "t.csv"
    d.mkdir(parents=True)
    for name, text in files.items():
        (d / f"{name}.csv").write_text(text, newline="")
    return str(d)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    body = "".join(f'{i},"name, {i}","say ""{i}"""\n' for i in range(40_000))
    path = folder(tmp_path, a="id,name,said\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        split = read_text_csv(spark, path)
        assert split.rdd.getNumPartitions() >= 4
        whole = read_text_csv(spark, path, multiline=True)
        assert whole.rdd.getNumPartitions() == 1
        assert split.count() == 40_000 and split.exceptAll(whole).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("line,whole", [
    ("a,b,c", True), ('"a","b,b","c"', True), ('"a ""q"" b",,""', True), ('"""",x', True), ('"a"""', True), ('"","",""', True), ('a""b,c', True),
    ('a,"b', False), ('b",c', False), ('"""', False), ('ab"c,d', False), ('a"b,"c', False), ('"a"b,c', False), ('x,"a"" ,y', False)])
def test_lines_that_are_whole_records(spark, tmp_path, line, whole):
    audit = audit_csv(spark, folder(tmp_path, a=f"h\n{line}\n")).collect()
    assert [(r.header, r.ragged == 0) for r in audit] == [("h", whole)]


def test_values_with_line_breaks_are_kept(spark, tmp_path):
    path = folder(tmp_path, a="k,v\n1,plain\n2,also\n", b='k,v\n3,"two\nlines"\n4,"quote "" and\n\nmore"\n', **{"c d%41{x}": "k,v\n5,x\n"})
    got = read_text_csv(spark, path)
    assert rows(got) == [("1", "plain"), ("2", "also"), ("3", "two\nlines"), ("4", 'quote " and\n\nmore'), ("5", "x")]


def test_every_files_header_counts(spark, tmp_path):
    path = folder(tmp_path, a="machineID,model,age\n1,m1,2\n", b="\nage,model,machineID\n7,m,2\n", c="machineID,model,age\r\n3,m3,4\r\n",
                  d="machineID,model\n9,m9\n", e="")
    t = read_csv_table(spark, path, mark_malformed=True)
    assert rows(t.df, "machineID", "model", "age") == [("1", "m1", "2"), ("2", "m", "7"), ("3", "m3", "4"), ("9", "m9", None)]
    assert t.headers[0] == (("machineID", "model", "age"), 2) and sorted(n for _, n in t.headers) == [1, 1, 2]
    assert t.df.columns[-1] == MALFORMED
    os.rename(path, tmp_path / "machines.csv")
    (tmp_path / "machines.csv" / "d.csv").write_text("machineID,model,age\n9,m9,1\n")
    inputs = V.read_raw_inputs(spark, str(tmp_path))
    rep = {(r.dataset, r.rule): r for r in gates.raw_gate_report(spark, inputs).collect()}
    assert rep[("machines", "columns_match")].violations == 1  # one file of four with rows
    only = [i for i in inputs if i.name == "machines"]
    with pytest.raises(gates.GateError, match=r"table machines: the columns are \['age', 'model', 'machineID'\]"):
        gates.enforce([r for r in rep.values() if r.dataset == "machines"], gates.raw_details(only))


def test_too_many_headers_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sparkmend.sources.csv.MAX_HEADERS", 2)
    with pytest.raises(ValueError, match="more than 2 different headers"):
        read_text_csv(spark, folder(tmp_path, a="x\n1\n", b="y\n1\n", c="z\n1\n"))


@pytest.mark.parametrize("multiline", [None, True])
def test_surplus_cells_of_all_kinds(spark, tmp_path, multiline):
    text = 'a,b,c\n1,2,3\n2,2\n3,2,,extra\n4,2,3,\n5,2,3,,\n6,"2,2",3\n7,"2,2",3,"x,y"\n8,,\n'
    got = read_csv_table(spark, folder(tmp_path, a=text), multiline, mark_malformed=True).df
    assert [r.a for r in got.where(MALFORMED).orderBy("a").collect()] == ["3", "4", "5", "7"]
    assert got.count() == 8 and got.where("a = 6").first().b == "2,2"


SAMPLES = [dt.datetime(2015, 1, 13, 6, 5, 4), dt.datetime(2015, 11, 2, 13, 0, 0)]
TEXTS = {
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M",
    "yyyy-MM-dd": "%Y-%m-%d", "M/d/yyyy h:mm:ss a": "%m/%d/%Y %I:%M:%S %p", "M/d/yyyy H:mm:ss": "%m/%d/%Y %H:%M:%S", "M/d/yyyy H:mm": "%m/%d/%Y %H:%M",
    "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy H:mm:ss": "%d/%m/%Y %H:%M:%S", "d/M/yyyy": "%d/%m/%Y", "yyyy/MM/dd HH:mm:ss": "%Y/%m/%d %H:%M:%S",
    "yyyy/MM/dd": "%Y/%m/%d", "M-d-yyyy": "%m-%d-%Y", "d-M-yyyy H:mm:ss": "%d-%m-%Y %H:%M:%S", "d.M.yyyy H:mm": "%d.%m.%Y %H:%M",
    "MMM d yyyy HH:mm:ss": "%b %d %Y %H:%M:%S", "MMM d, yyyy": "%b %d, %Y", "d MMM yyyy": "%d %b %Y", "yyyyMMdd": "%Y%m%d",
    "yyyy-MM-dd HH:mm:ss.[SSSSSSSSS][SSSSSS][SSSSS][SSSS][SSS][SS][S]": "%Y-%m-%d %H:%M:%S.%f",
}


def test_each_form_is_found_and_parsed(spark):
    assert set(TEXTS) <= {p for _, p in DATETIME_FORMS}
    for pattern, fmt in TEXTS.items():
        texts = [t.strftime(fmt) for t in SAMPLES]
        df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "datetime string")
        vote = datetime_votes(df).first()
        assert (vote.form, vote.present, vote.other) == (pattern, 2, 0), pattern
        inputs = V.with_datetime_forms(spark, [gates.RawInput("x", df)])
        from sparkmend.contracts import TableContract
        from sparkmend.sources.csv import cast_to_contract
        from pyspark.sql import types as T
        typed = cast_to_contract(df, TableContract("x", T.StructType([T.StructField("datetime", T.TimestampNTZType())])), datetime_form=inputs[0].datetime_form)
        assert {r.datetime for r in typed.collect()} == {dt.datetime.strptime(t, fmt) for t in texts} | {None}


def test_mixed_forms_are_a_violation(spark, write_csv):
    text = TABLES["telemetry"].replace("2015-01-01 08:00:00,1", "01/01/2015 08:00:00,1")
    inputs = V.read_raw_inputs(spark, write_all(write_csv, {"telemetry": text}))
    rep = {(r.dataset, r.rule): r for r in gates.raw_gate_report(spark, inputs).collect()}
    assert rep[("telemetry", "mixed_datetimes")].violations == 1 and rep[("errors", "mixed_datetimes")].passed
    assert rep[("telemetry", "unparseable_values")].violations == 0  # each value parses by itself
    with pytest.raises(gates.GateError, match="table telemetry: the datetime values do not all have one form"):
        V.validate_raw(spark, inputs)
    with pytest.raises(Exception, match="unparseable datetime"):
        V.typed_tables(inputs)["telemetry"].collect()
    empty = spark.createDataFrame([], "datetime string")
    assert tuple(datetime_votes(empty).first()) == (None, 0, 0)


def test_colliding_hashes_still_count_exactly(spark, write_csv, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (2, None), (3, "a")], "k long, v string")
    text = TABLES["telemetry"] + "2015-01-01 06:00:00,1,1.0,2.0,3.0,4.0\n" + TABLES["telemetry"].strip().split("\n")[1] + "\n"
    inputs = V.read_raw_inputs(spark, write_all(write_csv, {"telemetry": text}))

    def counts():
        rep = {(r.dataset, r.rule): r.violations for r in gates.raw_gate_report(spark, inputs).collect()}
        return [rep[("telemetry", r)] for r in ("duplicate_rows", "duplicate_keys", "null_cells")] + [rep[("errors", "duplicate_rows")]]

    assert audits.duplicate_rows(df).first()[0] == 3 and audits.surplus_rows(df, ["k"]).first()[0] == 4
    before = counts()
    assert before[:2] == [1, 2]
    monkeypatch.setattr(audits, "row_hashes", lambda cols, prefix: [F.lit(7).cast("long").alias(f"{prefix}{i}") for i in (0, 1)])
    assert audits.duplicate_rows(df).first()[0] == 3 and audits.surplus_rows(df, ["k"]).first()[0] == 4
    assert counts() == before

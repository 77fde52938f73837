"""Raw-gate counts against pandas on random small CSV tables (brute-force oracle)."""

import io
import itertools

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmend import contracts as C
from sparkmend.operators import gates
from sparkmend.sources.csv import read_text_csv

_counter = itertools.count()

DATES = ["2015-01-01 06:00:00", "2015-01-01 07:00:00", "NA"]
IDS = ["1", "2", "1.0", "01", ""]
VOLTS = ["1.5", "1.50", "2", "NaN", "null", ""]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(DATES), st.sampled_from(IDS), st.sampled_from(VOLTS)),
                min_size=1, max_size=12))
def test_counts_match_pandas(spark, tmp_path_factory, rows):
    header = "datetime,machineID,volt,rotate,pressure,vibration"
    text = header + "\n" + "\n".join(f"{d},{m},{v},1,2,3" for d, m, v in rows) + "\n"
    folder = tmp_path_factory.mktemp(f"t{next(_counter)}")
    (folder / "telemetry.csv").write_text(text)
    df = read_text_csv(spark, str(folder / "telemetry.csv"))
    pdf = pd.read_csv(io.StringIO(text))
    rep = {r.rule: r.violations for r in
           gates.raw_gate_report(spark, [gates.RawInput("telemetry", df)], {"telemetry": C.TELEMETRY}).collect()}
    assert rep["null_cells"] == int(pdf.isnull().sum().sum())
    assert rep["duplicate_rows"] == int(pdf.duplicated().sum())
    assert rep["duplicate_keys"] == int(pdf.duplicated(subset=["machineID", "datetime"]).sum())

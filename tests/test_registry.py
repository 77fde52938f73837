"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sparkmend import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False, name=None):
        row = []
        for v in r:
            if hasattr(v, "item") and not hasattr(v, "to_pydatetime"):
                v = v.item()
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                row.append(float(f"{float(v):.12g}"))
            elif hasattr(v, "to_pydatetime"):
                row.append(v.to_pydatetime())
            else:
                row.append(v.item() if hasattr(v, "item") else v)
        out.append(tuple(row))
    return sorted(out, key=repr)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["datetime", "machineID"]


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(registry.QUERIES) <= set(o)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    rel = con.execute(E.oracle_sql()[key])
    otypes = {d[0]: str(d[1]) for d in rel.description}
    odf = rel.df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    for f in sdf.schema.fields:
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == otypes[f.name], f.name
    pdf = sdf.toPandas()
    assert len(pdf) == len(odf)
    assert _rows(pdf) == _rows(odf)

import math
import numbers
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from pitchgrid.plans import catalogue


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["c_name", "n_name", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def shown(value):
    """A value as the two engines agree on it: numbers by value, missing ones alike."""
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    if isinstance(value, numbers.Number) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 4) + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str([shown(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)

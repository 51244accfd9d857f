"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from freshet import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(f"{x:.9g}") if isinstance(x, float) else x


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", workload.queries())
def test_query_matches_sql(spark, duck, name):
    got = workload.queries()[name](spark, SF).toPandas()
    want = duck.execute(workload.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)

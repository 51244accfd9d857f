"""Every registered query over messy and empty tables, against its SQL where it has one, and over the driver's tables."""

import os

import duckdb
import pandas as pd
import pytest
from fixtures import messy_tables, write_tables

import corpus_pipeline
from freshet.llm import queries

SF = "/root/testdata/sf0.001"
ALL = queries.queries() | {"pipeline": corpus_pipeline.run}
#: Rows that each gives for the messy tables; None where the count says nothing by itself.
ROWS = {"op3_language_id_pages": 7, "op6_arc_to_warc": 7, "op8_minhash_containment": None, "pipeline": None}


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("messy"), messy_tables())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), dict.fromkeys(messy_tables(), []))


def value(x):
    if x is None or x is pd.NA or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(f"{x:.9g}") if isinstance(x, float) else x


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


def from_sql(folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con.execute(queries.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", ALL)
def test_messy_rows_stay_whole(spark, messy, name):
    got = ALL[name](spark, messy).collect()
    wanted = ROWS.get(name, len(messy_tables()["documents"]))
    assert wanted is None or len(got) == wanted


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_matches_sql(spark, name):
    got, want = ALL[name](spark, SF).toPandas(), from_sql(SF, name)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_license_sql_on_unique_messy_rows(spark, tmp_path):
    tables = messy_tables()
    tables["documents"] = list({r[0]: r for r in tables["documents"] if r[0] is not None}.values())
    folder = write_tables(spark, tmp_path / "t", tables)
    for name in ("op9_line_frequency_rules", "op10_license_sentences"):
        assert plain(ALL[name](spark, folder).toPandas()) == plain(from_sql(folder, name))


@pytest.mark.parametrize("name", ["op2_bounded_ring_shards", "op8_minhash_containment"])
def test_native_operators_run_no_python(spark, messy, name):
    plan = ALL[name](spark, messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

"""Offsets of static stored streams over several partitions; what is read is compared, not only counted."""

import os

import duckdb
import pytest
from helpers import ms
from pyspark.sql import functions as F

from freshet import workload
from freshet.engine import Engine
from freshet.operators import tables

SF = "/root/testdata/sf0.1"
big = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_every_row_has_an_offset_of_its_own(spark, tmp_path, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(0, 200_000, 1, 7).select(F.col("id"), F.timestamp_millis(F.col("id") % 11).alias("event_time"), F.repeat(F.col("id").cast("string"), 10).alias("text"))
        out = tables.with_offset(wide.where("id % 5 <> 1").repartition(5, "id"))
        out.write.parquet(str(tmp_path / "out"))
        read = spark.read.parquet(str(tmp_path / "out"))
        found = read.agg(F.count("*"), F.countDistinct("offset"), F.min("offset"), F.max("offset"), F.countDistinct("id"), F.count(F.when(F.col("text") == F.repeat(F.col("id").cast("string"), 10), 1))).first()
        assert tuple(found) == (160_000, 160_000, 0, 159_999, 160_000, 160_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_offsets_are_given_out_only_when_asked_for(spark):
    e = Engine(spark)
    e.register_table("s", spark.createDataFrame([(ms(k), k) for k in range(20)], "event_time timestamp, v long").repartition(3))
    e.execute("a := s -> (project v) -> (store stream)")
    e.execute("b := a -> (filter by v > 4) -> (store stream)")
    plan = e.execute("(scan all from b) -> (project v)")._jdf.queryExecution().executedPlan().toString()
    assert e.stream("a").pending and e.stream("b").pending and "Sort" not in plan and "Exchange range" not in plan
    e.execute("c := b -> (project offset as at, v) -> (store stream)")
    rows = {r["v"]: r["at"] for r in e.execute("(scan all from c) -> (project at, v)").collect()}
    assert {r["v"]: r["offset"] for r in e.execute("(scan all from b)").collect()} == rows
    everything = {r["v"]: r["offset"] for r in e.execute("(scan all from a)").collect()}
    assert sorted(everything.values()) == list(range(20)) and rows == {v: at for v, at in everything.items() if v > 4}


def test_a_table_over_rows_without_offsets_is_settled(spark):
    e = Engine(spark)
    e.register_table("s", spark.createDataFrame([(ms(1), "k", v) for v in (3, 9, 4)], "event_time timestamp, k string, v long").repartition(3))
    e.execute("a := s -> (project k, v) -> (store stream)")
    e.execute("t := a -> (store table by k)")
    assert [r["v"] for r in e.execute("(scan all from t)").collect()] == [9]


@big
@pytest.mark.parametrize("name", ["union_positional", "join_stream_stream_left", "store_stream_offsets", "topic_bridge", "partition_repartition"])
def test_written_rows_of_stored_streams_at_scale(spark, tmp_path, name):
    workload.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    con.execute(f"CREATE TABLE want AS {workload.oracle_sql()[name]}")
    columns = ", ".join(f'"{c[0]}"' for c in con.execute("SELECT * FROM want LIMIT 0").description)
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    both = "(SELECT count(*) FROM want), (SELECT count(*) FROM got)"
    a, b = con.execute(f"SELECT {both}").fetchone()
    assert a == b and con.execute("SELECT count(*) FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM got)").fetchone()[0] == 0

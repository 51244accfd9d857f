import pytest
from helpers import ms, rows_of

from freshet.engine import Engine, split_statements
from freshet.errors import StatementError


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register_table("s", spark.createDataFrame([(0, ms(1000), "k1", 1), (1, ms(2000), "k1", None), (2, ms(3000), None, 5)], "offset long, event_time timestamp, k string, v long"))
    return e


@pytest.mark.parametrize(("text", "message"), [
    ("a := (filter by true)", "can't be the first"), ("a := s -> (store stream) -> (project k)", "must be the last"), ("a := s -> (aggregate count(v) by k) -> (filter by true)", "must be the last"),
    ("a := s -> (bridge from x partitions=1)", "must be the first"), ("a := s -> (project k) -> (backfill)", "must directly follow"), ("a := (topic partitions=1) -> (project key)", "only operator"),
    ("event_time := s -> (project k)", "reserved"), ("s := s -> (project k)", "exists already"), ("a := nothing -> (project k)", "unknown stream"), ("a := s -> (project k as offset)", "reserved"),
    ("a := s -> (project event_time)", "can't be projected"), ("a := s -> (project k, k)", "two columns"), ("a := s -> (sort by k)", "no place in a stream"), ("a := (join s with s by k=k)", "needs 'within'"),
    ("a := (join s with table s by k=k)", "not a table"), ("a := (union s, b)", "unknown stream"), ("a := s -> (store table by z)", "unknown key column"), ("a := s -> (kafka out)", "topic's columns"),
    ("a := s -> (aggregate count(v) by k size=5s)", "together"), ("a := s -> (aggregate v by k)", "one of sum"), ("a := s -> (aggregate sum(k))", "doesn't take string"), ("a := (bridge from t partitions=1)", "unknown topic"),
    ("(scan all from s) -> (sort by k) -> (filter by true)", "last operator"), ("(scan all from s) -> (store stream)", "no place in a query"), ("(scan all from nope)", "no stored"), ("(get 1 from s)", "has one"), ("a := s -> (filter by v)", "bool"),
    ("a := s -> (project k) extra", "unexpected"), ("a := s -> (projekt k)", "unknown operator"), ("a := s -> (store stream retention=5)", "duration"),
])
def test_statements_that_fail(engine, text, message):
    with pytest.raises(StatementError, match=message):
        engine.execute(text)


def test_projection_names_and_system_columns(engine):
    engine.execute("p := s -> (project k, v + 1, event_time as at, len(k) as n) -> (store stream)")
    assert engine.execute("(scan all from p)").columns == ["offset", "event_time", "k", "col1", "at", "n"]
    assert engine.execute("(scan all from p) -> (project col1, n)").columns == ["col1", "n"]
    engine.execute("a := s -> (aggregate sum( v ), max(v) as top by k, v % 2)")
    assert engine.execute("(scan all from a)").columns == ["event_time", "k", "v%2", "sum(v)", "top"]


def test_aggregates(spark, engine):
    engine.execute("a := s -> (aggregate sum(v) as s, count(v) as n, min(v) as lo, avg(v) as m by k)")
    assert rows_of(engine.execute("(scan all from a)")) == sorted([(2000, "k1", 1, 1, 1, 1.0), (3000, None, 5, 1, 5, 5.0)], key=repr)
    engine.execute("g := s -> (aggregate count(v) as n)")
    assert rows_of(engine.execute("(scan all from g)")) == [(3000, 2)]


def test_identity_of_empty_sums(spark):
    e = Engine(spark, identity_nulls=True)
    e.register_table("s", spark.createDataFrame([(ms(1), None)], "event_time timestamp, v long"))
    e.execute("a := s -> (aggregate sum(v) as s)")
    assert rows_of(e.execute("(scan all from a)"), "s") == [(0,)]


def test_windows_end_at_multiples_of_the_hop(spark):
    e = Engine(spark, final_watermark=230)
    times = [(10, "UK", 1), (95, "UK", 2), (105, "UK", 4), (199, "FR", 8)]
    e.register_table("s", spark.createDataFrame([(ms(t), c, v) for t, c, v in times], "event_time timestamp, country string, v long"))
    e.execute("w := s -> (aggregate sum(v) as s by country size=100ms hop=10ms window_cols=true)")
    expected = {}
    for t, c, v in times:
        we = 10 * (1 + t // 10)
        while we - 100 <= t:
            if we - 1 <= 230:
                at, s = expected.get((we, c), (0, 0))
                expected[we, c] = (max(at, t), s + v)
            we += 10
    assert rows_of(e.execute("(scan all from w)")) == sorted([(at, we - 100, we, c, s) for (we, c), (at, s) in expected.items()], key=repr)


def test_published_window_rows(spark):
    e = Engine(spark, final_watermark=1136214262000 - 1000)
    base = 1136214240000  # 2006-01-02 15:04:00
    rows = [(0, "FR", "18.7"), (23, "UK", "23.7"), (78, "UK", "25.1"), (11, "USA", "13.3"), (33, "USA", "26.9")]
    e.register_table("s", spark.createDataFrame([(ms(base + t), c, v) for t, c, v in rows], "event_time timestamp, country string, t string"))
    e.execute("r := s -> (project country, to_decimal(t, 38, 6) as temperature) -> (store stream)")
    e.execute("w := r -> (partition by country partitions=10) -> (aggregate count(temperature), max(temperature), min(temperature), avg(temperature) by country size=4s hop=2s window_cols=true)")
    stats = {"FR": (0, 1, 18.7, 18.7, 18.7), "UK": (78, 2, 25.1, 23.7, 24.4), "USA": (33, 2, 26.9, 13.3, 20.1)}
    expected = [(base + at, base + we - 4000, base + we, c, *rest) for c, (at, *rest) in stats.items() for we in (2000, 4000)]
    assert rows_of(e.execute("(scan all from w)")) == sorted(expected, key=repr)


def joined(spark, how, keys="k=k", within="5s"):
    e = Engine(spark)
    schema = "offset long, event_time timestamp, k string, g string, v long"
    e.register_table("a", spark.createDataFrame([(0, ms(10_000), "x", "g", 1), (1, ms(20_000), "y", None, 2), (2, ms(0), None, None, 3), (3, ms(50_000), "q", "g", 4)], schema))
    e.register_table("b", spark.createDataFrame([(0, ms(15_000), "x", "g", 10), (1, ms(15_001), "x", "g", 11), (2, ms(20_000), "y", None, 12), (3, ms(0), None, None, 13), (4, ms(90_000), "z", "g", 14)], schema))
    e.execute(f"j := (join a with b by {keys.replace('=', how)} within {within}) -> (store stream)")
    return rows_of(e.execute("(scan all from j)"), "event_time", "l_v", "r_v")


def test_stream_joins(spark):
    inner = [(15_000, 1, 10), (20_000, 2, 12)]
    assert joined(spark, "=") == sorted(inner)  # both ends of the span belong to it; rows whose keys are all null take no part
    assert joined(spark, "*=") == sorted([*inner, (50_000, 4, None)], key=repr)
    assert joined(spark, "=*") == sorted([*inner, (15_001, None, 11), (90_000, None, 14)], key=repr)
    assert joined(spark, "=", "k=k, g=g") == sorted(inner)  # one null key of two is equal to another null


def test_join_columns(spark):
    e = Engine(spark)
    e.register_table("a", spark.createDataFrame([(0, ms(0), 7, "x")], "offset long, event_time timestamp, id long, p string"))
    e.register_table("b", spark.createDataFrame([(0, ms(1), 7, "y")], "offset long, event_time timestamp, ref long, q string"))
    e.register_table("t", spark.createDataFrame([(ms(1), 7, "y")], "event_time timestamp, ref long, q string"), ["ref"])
    e.execute("j := (join a with b by id=ref within 5m) -> (store stream)")
    assert [c for c in e.stream("j").df.columns if c != "offset"] == ["event_time", "l_event_time", "l_id", "l_p", "r_event_time", "r_q"]
    e.execute("k := (join a with table t by id=ref) -> (store stream)")
    assert [c for c in e.stream("k").df.columns if c != "offset"] == ["event_time", "l_id", "l_p", "r_event_time", "r_q"]
    for text, message in (("x := (join a with table t by id=*ref)", "outer side"), ("x := (join a with table t by p=q)", "whole key"), ("x := (join table t with table t by ref=ref)", "two tables"), ("x := (join a with table t by id=ref within 5s)", "neither"), ("x := (join a with b by id=q within 5s)", "different types")):
        with pytest.raises(StatementError, match=message):
            e.execute(text)


def test_union(spark, engine):
    engine.register_table("o", spark.createDataFrame([(ms(9), "z", 9)], "event_time timestamp, kk string, vv long"))
    engine.execute("u := (union s, o) -> (store stream)")
    assert sorted(map(repr, rows_of(engine.execute("(scan all from u)"), "k", "v"))) == sorted(map(repr, [("k1", 1), ("k1", None), (None, 5), ("z", 9)]))
    engine.register_table("w", spark.createDataFrame([(ms(9), "z", 9.0)], "event_time timestamp, kk string, vv double"))
    with pytest.raises(StatementError, match="input 2"):
        engine.execute("x := (union s, w)")


def test_tables_keep_the_last_row(spark):
    e = Engine(spark)
    e.register_table("s", spark.createDataFrame([(0, ms(5), "a", 1), (1, ms(5), "a", None), (2, ms(1), None, 3), (3, ms(2), None, 4)], "offset long, event_time timestamp, k string, v long"))
    e.execute("t := s -> (store table by k)")
    assert rows_of(e.execute("(scan all from t)"), "k", "v") == sorted([("a", None), (None, 4)], key=repr)
    e.execute("one := s -> (store table)")
    assert rows_of(e.execute("(scan all from one)"), "k", "v") == [("a", None)]


@pytest.fixture(scope="module")
def keyed(spark):
    e = Engine(spark)
    keys = [(a, b) for a in (None, 1, 2, 3) for b in (None, 1, 2, 3)]
    e.register_table("t", spark.createDataFrame([(a, b, 10 * (a or 0) + (b or 0)) for a, b in keys], "a long, b long, v long"), ["a", "b"])
    return e, keys


@pytest.mark.parametrize("low", ["1", "2", "1, 2", "2, 3", "start"])
@pytest.mark.parametrize("high", ["2", "3", "2, 2", "end"])
@pytest.mark.parametrize("incl", [("", ""), ("excl", "incl")])
def test_range_scans(keyed, low, high, incl):
    e, keys = keyed
    bound = lambda t: tuple(map(int, t.split(", ")))
    rank = lambda k: tuple(-1 if x is None else x for x in k)

    def inside(k):
        if low != "start":
            b = bound(low)
            p = rank(k)[: len(b)]
            if p < b or p == b and incl[0] == "excl":
                return False
        if high != "end":
            b = bound(high)
            p = rank(k)[: len(b)]
            if p > b or p == b and incl[1] != "incl":
                return False
        return True

    text = f"(scan {low} {incl[0] if low != 'start' else ''} to {high} {incl[1] if high != 'end' else ''} from t)"
    assert {(r["a"], r["b"]) for r in e.execute(text).collect()} == {k for k in keys if inside(k)}


def test_lookups_and_prepared_queries(keyed):
    e, _ = keyed
    assert rows_of(e.execute("(get 2, 3 from t)"), "v") == [(23,)]
    assert len(e.execute("(get 2 from t)").collect()) == 4
    e.execute("prepare q := (get $a:int, $b:int from t) -> (project v)")
    assert rows_of(e.execute_prepared("q", {"a": 3, "b": None})) == [(30,)]
    with pytest.raises(StatementError, match="not of type int"):
        e.execute_prepared("q", {"a": "x", "b": 1})
    with pytest.raises(StatementError, match="argument|type"):
        e.execute('(get "x" from t)')
    e.execute("deletequery(q)")
    with pytest.raises(StatementError, match="unknown prepared"):
        e.execute_prepared("q")


def test_sorting(keyed):
    e, keys = keyed
    got = [(r["a"], r["b"]) for r in e.execute("(scan all from t) -> (sort by a desc, b)").collect()]
    assert got == sorted(keys, key=lambda k: (-(k[0] or 0), -1 if k[1] is None else k[1]))


def test_catalog(engine):
    engine.execute("p := s -> (filter by v > 1) -> (store stream)")
    engine.execute("c := p -> (backfill) -> (store table by k)")
    assert [r[0] for r in engine.execute('list("^[cp]$")').collect()] == ["c", "p"]
    assert [r[0] for r in engine.execute("list()").collect()] == ["c", "p", "s"]
    shown = engine.execute("show(c)").first()
    assert shown["stored_as"] == "table" and shown["key_columns"] == "k"
    with pytest.raises(StatementError, match="children: c"):
        engine.execute("delete(p)")
    engine.execute("delete(c)")
    engine.execute("delete(p)")
    with pytest.raises(StatementError, match="unknown stream"):
        engine.execute("delete(p)")


def test_scripts_split_outside_strings():
    assert [s.strip() for s in split_statements('a := b -> (filter by x == ";");\n-- a comment; here\n(scan all from a);')] == ['a := b -> (filter by x == ";")', "-- a comment; here\n(scan all from a)"]


def test_topics(spark):
    e = Engine(spark)
    e.bind_topic("in1", spark.createDataFrame([(ms(1), b"k", b'{"v":1}'), (ms(2), None, b"")], "event_time timestamp, key binary, val binary"))
    e.execute('in1 := (topic partitions=4)')
    assert rows_of(e.execute("(scan all from in1)"), "event_time") == [(1,), (2,)]
    assert [r["val"] for r in e.execute("(scan all from in1) -> (filter by is_null(val))").collect()] == [None]


def test_script_files(spark):
    from freshet import script

    data = 'dataset:d1,e,t\nkey01,"h1:a,h2:b","{""v0"": 1}","2006-01-02 15:04:05.000"\nkey02,nil,"{""v0"": 2}","2006-01-02 15:04:06.000"\n\nnot read'
    text = """set max_line_width 200;
--create topic t 16;
s := (bridge from t partitions = 16 props = ()) -> (project key, kafka_header("h1", hdrs) as h1, json_int("v0", val) as v0) -> (store stream);
--load data d1;
(scan all from s) -> (sort by v0 desc);
delete(nope);
delete(s);
"""
    out = script.run(Engine(spark), text, data)
    assert [(r["h1"], r["v0"]) for r in out[0].collect()] == [(None, 2), ("a", 1)]
    assert isinstance(out[1], StatementError)


def test_options_of_connectors():
    from freshet.sources import topics

    assert topics.kafka_options("t", {"bootstrap.servers": "h:1", "auto.offset.reset": "earliest"}, 5) == {"subscribe": "t", "includeHeaders": "true", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5", "kafka.bootstrap.servers": "h:1"}
    assert topics.sink_options("t", {"initial_retry_delay": 2000, "props": {"a": "b"}})["kafka.retry.backoff.ms"] == "2000"

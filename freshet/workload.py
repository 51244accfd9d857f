"""Registered queries over the test tables, each with the SQL that must give the same rows.

Nearly all are statements of the pipeline language; results carry event times as milliseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import tables
from .session import prepare, shared_folder
from .sources import results, topics
from .streaming.runtime import Folder, Runtime

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _events(df: DataFrame) -> DataFrame:
    """With columns that hold nulls: user (every 5th), amount (every 7th) and kind (every 11th), and flags."""
    null_each = lambda n, c: F.when(F.col("event_id") % n != 0, F.col(c))
    return df.select(
        F.col("event_id").alias("offset"), F.col("ts").alias("event_time"), "event_id", "user_id", "event_type", "value", "props", null_each(5, "user_id").alias("user"), null_each(7, "value").alias("amount"), null_each(11, "event_type").alias("kind"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") > 20).alias("flag"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 2 == 0).alias("even"),
    )


#: The same columns in DuckDB.
EVENTS = """e AS (SELECT event_id, epoch_us(ts) // 1000 et, user_id, event_type, value, props, CASE WHEN event_id % 5 <> 0 THEN user_id END "user", CASE WHEN event_id % 7 <> 0 THEN value END amount,
 CASE WHEN event_id % 11 <> 0 THEN event_type END kind, CASE WHEN event_id % 3 <> 0 THEN value > 20 END flag, CASE WHEN event_id % 4 <> 0 THEN user_id % 2 = 0 END even FROM events)"""


def load(spark: SparkSession, sf_dir: str, engine: Engine | None = None, *names: str) -> Engine:
    engine = engine or Engine(prepare(spark))
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for name in names or ("events",):
        if name == "events":
            engine.register_table("events", _events(read("events")))
        elif name == "orders":
            engine.register_table("orders", read("orders").withColumn("event_time", F.col("o_orderdate")))
        elif name == "lineitem":
            engine.register_table("lineitem", read("lineitem").withColumn("event_time", F.col("l_shipdate")))
        elif name == "customer":
            engine.register_table("customer", read("customer"), ["c_custkey"])
        elif name == "customer_by_nation":
            engine.register_table("customer_by_nation", read("customer"), ["c_nationkey", "c_custkey"])
        elif name == "nation":
            engine.register_table("nation", read("nation"), ["n_nationkey"])
        elif name == "supplier":
            engine.register_table("supplier", read("supplier").withColumn("s_group", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey"))), ["s_group", "s_suppkey"])
        elif name == "topic":
            engine.bind_topic("event_topic", read("events").select(F.col("event_id").alias("offset"), F.col("ts").alias("event_time"), F.encode(F.col("event_type"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("val")))
    return engine


def query(name: str, sql: str | None, *statements: str, tables_: tuple[str, ...] = ("events",), **settings):
    """Register deployments and, last, the query whose result counts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = load(spark, sf_dir, Engine(prepare(spark), **settings), *tables_)
        for s in statements[:-1]:
            engine.execute(s)
        return engine.execute(statements[-1])

    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def built(name: str, sql: str | None = None):
    def register(run):
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return register


E = f"WITH {EVENTS} "

# ---------------------------------------------------------------- filters and projections

query("filter_and_null_logic", E + "SELECT event_id FROM e WHERE (CASE WHEN flag IS NULL THEN NULL WHEN flag THEN true ELSE even END) AND (amount > 5 AND amount IS NOT NULL)",
      "f := events -> (filter by (flag || even) && amount > 5.0f) -> (store stream)", "(scan all from f) -> (project event_id)")
query("project_null_logic", E + "SELECT event_id, CASE WHEN flag IS NULL OR even IS NULL THEN NULL ELSE flag AND even END both_true, CASE WHEN flag IS NULL THEN NULL WHEN flag THEN true ELSE even END any_true, NOT flag not_flag FROM e",
      "(scan all from events) -> (project event_id, flag && even as both_true, flag || even as any_true, !flag as not_flag)")
query("filter_in_matches", E + "SELECT event_id, kind FROM e WHERE kind IN ('click', 'view') AND regexp_matches(props, '[13579]\\}$')",
      '(scan all from events) -> (filter by in(kind, "click", "view") && matches(props, "[13579]}$")) -> (project event_id, kind)')
query("filter_comparisons", E + "SELECT event_id FROM e WHERE amount <> 1 AND event_type >= 'e' AND user_id <= 60 AND et > 1704067200000",
      '(scan all from events) -> (filter by amount != 1.0f && event_type >= "e" && user_id <= 60 && event_time > to_timestamp(1704067200000)) -> (project event_id)')
query("project_arith", E + 'SELECT event_id, event_id + user_id * 3 a, event_id - (user_id - 7) b, (event_id + 10) // (user_id + 1) c, event_id % (user_id + 1) d, value * 2.5 - 1 f, -3 neg, abs(user_id - 50) g, abs(value - 20) h FROM e',
      "(scan all from events) -> (project event_id, event_id + user_id * 3 as a, event_id - user_id - 7 as b, (event_id + 10) / (user_id + 1) as c, event_id % (user_id + 1) as d, value * 2.5f - 1f as f, -3 as neg, abs(user_id - 50) as g, abs(value - 20f) as h)")
_D = "CAST(value AS DECIMAL(12,2)) v, CAST(user_id + 1 AS DECIMAL(10,1)) u"
query("project_decimal", E + f"SELECT event_id, CAST(v + u AS DOUBLE) s, CAST(v - u AS DOUBLE) d, CAST(v * u AS DOUBLE) p, CAST((CAST(v * 100 AS HUGEINT) * 10) // CAST(u * 10 AS HUGEINT) AS DOUBLE) / 100 q, CAST(floor(v) AS BIGINT) i, CAST(CAST(v * 100 AS DECIMAL(12,2)) AS DOUBLE) sh FROM (SELECT event_id, {_D} FROM e)",
      "d := events -> (project event_id, to_decimal(value, 12, 2) as v, to_decimal(user_id + 1, 10, 1) as u) -> (store stream)",
      "(scan all from d) -> (project event_id, to_float(v + u) as s, to_float(v - u) as d, to_float(v * u) as p, to_float(v / u) as q, to_int(v) as i, to_float(decimal_shift(v, 2)) as sh)")
query("project_conditional", E + """SELECT event_id, CASE WHEN flag IS NULL THEN NULL WHEN flag THEN 'big' ELSE 'small' END size, CASE WHEN kind IS NULL THEN NULL WHEN kind = 'click' THEN 1 WHEN kind = 'view' THEN 2 ELSE 0 END code,
 amount IS NULL no_amount, amount IS NOT NULL has_amount, CASE WHEN "user" IS NOT NULL THEN "user" IN (1, 2, 3) END low FROM e""",
      '(scan all from events) -> (project event_id, if(flag, "big", "small") as size, case(kind, "click", 1, "view", 2, 0) as code, is_null(amount) as no_amount, is_not_null(amount) as has_amount, in(user, 1, 2, 3) as low)')
query("project_strings", E + """SELECT event_id, strlen(props) n, event_type || ':' || props j, starts_with(event_type, 'c') st, ends_with(event_type, 'r') en, trim(props, '{}') t, ltrim(props, '{"') l, rtrim(props, '0123456789}') r,
 upper(event_type) up, lower(upper(event_type)) lo, substring(props, 2, 3) ss, replace(props, 'k', 'key') rp FROM e""",
      '(scan all from events) -> (project event_id, len(props) as n, concat(event_type, concat(":", props)) as j, starts_with(event_type, "c") as st, ends_with(event_type, "r") as en, trim(props, "{}") as t, ltrim(props, "{\\"") as l, rtrim(props, "0123456789}") as r, to_upper(event_type) as up, to_lower(to_upper(event_type)) as lo, sub_str(props, 1, 4) as ss, replace(props, "k", "key") as rp)')
query("project_casts", E + "SELECT event_id, CAST(trunc(value) AS BIGINT) ti, CAST(user_id AS DOUBLE) tf, CAST(user_id AS VARCHAR) ts, CAST(CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS DOUBLE) sf, et, CAST(et AS VARCHAR) es, CAST(floor(CAST(value AS DECIMAL(12,2))) AS BIGINT) di FROM e",
      "(scan all from events) -> (project event_id, to_int(value) as ti, to_float(user_id) as tf, to_string(user_id) as ts, to_float(to_string(user_id)) as sf, to_int(event_time) as et, to_string(event_time) as es, to_int(to_decimal(value, 12, 2)) as di)")
query("project_dates", E + """SELECT event_id, CAST(year(t) AS BIGINT) y, CAST(month(t) AS BIGINT) mo, CAST(day(t) AS BIGINT) d, CAST(hour(t) AS BIGINT) h, CAST(minute(t) AS BIGINT) mi, CAST(second(t) AS BIGINT) s, et % 1000 ms, strftime(t, '%Y-%m-%d %H:%M:%S') f,
 epoch_ms(strptime(strftime(t, '%d/%m/%Y'), '%d/%m/%Y')) back FROM (SELECT event_id, et, make_timestamp(et * 1000) t FROM e)""",
      '(scan all from events) -> (project event_id, year(event_time) as y, month(event_time) as mo, day(event_time) as d, hour(event_time) as h, minute(event_time) as mi, second(event_time) as s, millis(event_time) as ms, format_date(event_time, "2006-01-02 15:04:05") as f, to_int(parse_date(format_date(event_time, "02/01/2006"), "02/01/2006")) as back)')
query("project_json", E + "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k, CAST(json_extract_string(props, '$.k') AS DOUBLE) kf, json_extract_string(props, '$.k') ks, CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0 kb, json_extract(props, '$.k') :: VARCHAR kr, false kn, 'number' kt, CAST(NULL AS BIGINT) missing FROM e",
      '(scan all from events) -> (project event_id, json_int("k", props) as k, json_float("k", props) as kf, json_string("k", props) as ks, json_bool("k", props) as kb, json_raw("k", props) as kr, json_is_null("k", props) as kn, json_type("k", props) as kt, json_int("none.at.all", props) as missing)')
query("project_bytes", E + "SELECT event_id, strlen(event_type) n, substring(event_type, 2, 2) sl, CAST('0x' || substring(hex(encode(event_type || '........')), 1, 16) AS BIGINT) be FROM e",
      'b := events -> (project event_id, to_bytes(event_type) as raw, to_bytes(concat(event_type, "........")) as wide) -> (store stream)', "(scan all from b) -> (project event_id, len(raw) as n, to_string(bytes_slice(raw, 1, 3)) as sl, uint64_be(wide, 0) as be)")
query("project_sprintf", E + "SELECT event_id, event_type || '/' || user_id || '%' s FROM e", '(scan all from events) -> (project event_id, sprintf("%s/%d%%", event_type, user_id) as s)')

#: A document for each row: nulls, absent members and every kind of value.
_DOCS = """if(event_id % 5 == 0, "{\\"k\\": null, \\"o\\": {\\"b\\": true}}", if(event_id % 5 == 1, "{\\"k\\": \\"text\\", \\"o\\": [1]}", if(event_id % 5 == 2, "{\\"k\\": false}", if(event_id % 5 == 3, "{\\"k\\": [7]}", props))))"""
_DOCS_SQL = """CASE event_id % 5 WHEN 0 THEN '{"k": null, "o": {"b": true}}' WHEN 1 THEN '{"k": "text", "o": [1]}' WHEN 2 THEN '{"k": false}' WHEN 3 THEN '{"k": [7]}' ELSE props END"""
query("project_json_kinds", E + f"""SELECT event_id, CASE json_type(d, '$.k') WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'json' ELSE 'number' END kt, json_type(d, '$.k') = 'NULL' kn,
 CASE WHEN json_exists(d, '$.o') THEN json_type(d, '$.o') = 'NULL' END missing_null, CASE WHEN json_exists(d, '$.o') THEN 'json' END ot, CASE WHEN json_exists(d, '$.o.b') THEN true END b FROM (SELECT event_id, {_DOCS_SQL} d FROM e)""",
      f"d := events -> (project event_id, {_DOCS} as d) -> (store stream)", '(scan all from d) -> (project event_id, json_type("k", d) as kt, json_is_null("k", d) as kn, json_is_null("o", d) as missing_null, json_type("o", d) as ot, json_bool("o.b", d) as b)')
query("project_uint64_le", E + "SELECT event_id, CAST('0x' || hex(encode(reverse(substring(event_type || '........', 1, 8)))) AS BIGINT) le FROM e",
      '(scan all from events) -> (project event_id, uint64_le(to_bytes(concat(event_type, "........")), 0) as le)')
query("project_wide_strings", E + "SELECT event_id, strlen('é' || event_type) n, upper('é' || event_type) up, starts_with('日本' || event_type, '日') st, replace('aé' || event_type, 'é', 'ß') rp FROM e",
      '(scan all from events) -> (project event_id, len(concat("é", event_type)) as n, to_upper(concat("é", event_type)) as up, starts_with(concat("日本", event_type), "日") as st, replace(concat("aé", event_type), "é", "ß") as rp)')
query("project_decimal_down", E + "SELECT event_id, CAST(round(CAST(value AS DECIMAL(12,2)) / 10, 2) AS DOUBLE) tenth FROM (SELECT event_id, CAST(floor(value) AS BIGINT) value FROM e)",
      "(scan all from events) -> (project event_id, to_float(decimal_shift(to_decimal(to_int(value), 12, 2), -1)) as tenth)")

# ---------------------------------------------------------------- aggregation

query("agg_global", E + "SELECT max(et) et, count(event_id) n, CAST(sum(user_id) AS BIGINT) s, min(value) lo, max(value) hi FROM e",
      "a := events -> (aggregate count(event_id) as n, sum(user_id) as s, min(value) as lo, max(value) as hi)", "(scan all from a) -> (project to_int(event_time) as et, n, s, lo, hi)")
query("agg_by_key", E + 'SELECT event_type, max(et) et, count("user") n, CAST(sum("user") AS BIGINT) s, min("user") lo, max("user") hi, avg("user") mean FROM e GROUP BY event_type',
      "a := events -> (partition by event_type partitions=8) -> (aggregate count(user) as n, sum(user) as s, min(user) as lo, max(user) as hi, avg(user) as mean by event_type)", "(scan all from a) -> (project event_type, to_int(event_time) as et, n, s, lo, hi, mean)")
query("agg_by_expr", E + "SELECT user_id % 10 bucket, event_type = 'click' is_click, count(value) n, min(event_type) lo, max(event_type) hi FROM e GROUP BY ALL",
      'a := events -> (aggregate count(value) as n, min(event_type) as lo, max(event_type) as hi by user_id % 10 as bucket, event_type == "click" as is_click)', "(scan all from a) -> (project bucket, is_click, n, lo, hi)")
query("agg_nulls", E + 'SELECT kind, count("user") n, CAST(sum(nullif("user", 0)) AS BIGINT) s, max(amount) hi FROM e GROUP BY kind',
      "a := events -> (aggregate count(user) as n, sum(user) as s, max(amount) as hi by kind)", "(scan all from a) -> (project kind, n, s, hi)")
query("agg_identity_nulls", E + "SELECT event_id % 7 g, CAST(coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN user_id END), 0) AS BIGINT) s FROM e GROUP BY ALL",
      "n := events -> (project event_id % 7 as g, if(amount > -1000f, user_id, user_id) as maybe) -> (store stream)", "a := n -> (aggregate sum(maybe) as s by g)", "(scan all from a) -> (project g, s)", identity_nulls=True)
query("agg_avg_decimal_ts", E + "SELECT event_type, CAST(CAST(avg(value) AS DECIMAL(38,6)) AS DOUBLE) mean, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) total, CAST(floor(avg(et)) AS BIGINT) mid FROM e GROUP BY event_type",
      "a := events -> (aggregate avg(to_decimal(value, 38, 6)) as mean, sum(to_decimal(value, 38, 6)) as total, avg(event_time) as mid by event_type)", "(scan all from a) -> (project event_type, to_float(mean) as mean, to_float(total) as total, to_int(mid) as mid)")


def _window_sql(size: int, hop: int, having: str = "") -> str:
    return f"""WITH {EVENTS}, w AS (SELECT *, {hop} * (1 + et // {hop}) + k * {hop} we FROM e, range(0, {size // hop + 2}) r(k))
SELECT we - {size} w_start, we w_end, event_type, max(et) et, count(value) n, CAST(sum(user_id) AS BIGINT) s, min(value) lo, max(value) hi FROM w WHERE we - {size} <= et {having} GROUP BY we, event_type"""


_WIN = "aggregate count(value) as n, sum(user_id) as s, min(value) as lo, max(value) as hi by event_type"
_OUT = "(scan all from w) -> (project to_int(ws) as w_start, to_int(we) as w_end, event_type, to_int(event_time) as et, n, s, lo, hi)"
_HOUR = 3_600_000
query("win_tumbling", _window_sql(24 * _HOUR, 24 * _HOUR), f"w := events -> ({_WIN} size=24h hop=24h window_cols=true)", _OUT)
query("win_hopping", _window_sql(4 * _HOUR, _HOUR), f"w := events -> ({_WIN} size=4h hop=1h window_cols=true)", _OUT)
query("win_hop_unaligned", _window_sql(5 * _HOUR, 2 * _HOUR), f"w := events -> ({_WIN} size=5h hop=2h window_cols=true)", _OUT)
_CLOSED = 1704067200000 + 5 * 24 * _HOUR
query("win_closed_only", _window_sql(4 * _HOUR, _HOUR, f"AND we - 1 + 5000 <= {_CLOSED}"), f"w := events -> ({_WIN} size=4h hop=1h lateness=5s window_cols=true)", _OUT, final_watermark=_CLOSED)

# ---------------------------------------------------------------- joins and union

_O = "o AS (SELECT *, epoch_us(o_orderdate) // 1000 et FROM orders), l AS (SELECT *, epoch_us(l_shipdate) // 1000 et FROM lineitem)"
for _how, _sign in (("inner", "="), ("left", "*="), ("right", "=*")):
    query(f"join_stream_stream_{_how}", f"WITH {_O} SELECT greatest(o.et, l.et) et, o_orderkey, o_custkey, l_linenumber, l_quantity FROM o {_how} JOIN l ON o_orderkey = l_orderkey AND abs(o.et - l.et) <= {30 * 24 * _HOUR}",
          f"j := (join orders with lineitem by o_orderkey {_sign} l_orderkey within 30d) -> (store stream)", "(scan all from j) -> (project to_int(event_time) as et, l_o_orderkey as o_orderkey, l_o_custkey as o_custkey, r_l_linenumber as l_linenumber, r_l_quantity as l_quantity)", tables_=("orders", "lineitem"))
query("join_nullsafe_keys", E + """SELECT a.event_id x, b.event_id y, greatest(a.et, b.et) et FROM e a JOIN e b ON a."user" IS NOT DISTINCT FROM b."user" AND a.kind IS NOT DISTINCT FROM b.kind AND abs(a.et - b.et) <= 600000
 WHERE NOT (a."user" IS NULL AND a.kind IS NULL)""",
      "other := events -> (project event_id, user, kind) -> (store stream)", "j := (join events with other by user = user, kind = kind within 10m) -> (store stream)", "(scan all from j) -> (project l_event_id as x, r_event_id as y, to_int(event_time) as et)")
query("join_stream_table_inner", f"WITH {_O} SELECT et, o_orderkey, c_custkey, c_name FROM o JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10",
      "big := (join orders with table customer by o_custkey = c_custkey) -> (filter by r_c_nationkey < 10) -> (store stream)", "(scan all from big) -> (project to_int(event_time) as et, l_o_orderkey as o_orderkey, l_o_custkey as c_custkey, r_c_name as c_name)", tables_=("orders", "customer"))
query("join_stream_table_left", E + ", m AS (SELECT * FROM nation) SELECT event_id, n_name FROM e LEFT JOIN m ON e.\"user\" = n_nationkey WHERE \"user\" IS NOT NULL",
      "j := (join events with table nation by user *= n_nationkey) -> (store stream)", "(scan all from j) -> (project l_event_id as event_id, r_n_name as n_name)", tables_=("events", "nation"))
query("union_positional", f"WITH {_O} SELECT et, o_orderkey k, o_totalprice x FROM o UNION ALL SELECT et, l_orderkey, l_extendedprice FROM l",
      "a := orders -> (project o_orderkey as k, o_totalprice as x) -> (store stream)", "b := lineitem -> (project l_orderkey as kk, l_extendedprice as xx) -> (store stream)", "u := (union a, b) -> (store stream)", "(scan all from u) -> (project to_int(event_time) as et, k, x)", tables_=("orders", "lineitem"))

# ---------------------------------------------------------------- stored streams and tables

query("store_table_latest", E + "SELECT user_id, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY et DESC, event_id DESC) = 1", "t := events -> (store table by user_id)", "(scan all from t) -> (project user_id, event_id, event_type)")
query("store_table_nokey", E + "SELECT event_id, event_type FROM e ORDER BY et DESC, event_id DESC LIMIT 1", "t := events -> (store table)", "(scan all from t) -> (project event_id, event_type)")

@built("store_stream_offsets", "SELECT count(*) n, 0 lowest, count(*) - 1 highest, count(*) distinct_offsets FROM orders")
def store_stream_offsets(spark, sf_dir):
    engine = load(spark, sf_dir, None, "orders")
    engine.execute("s := orders -> (project o_orderkey) -> (store stream)")
    return engine.execute("(scan all from s)").agg(F.count("*").alias("n"), F.min("offset").alias("lowest"), F.max("offset").alias("highest"), F.countDistinct("offset").alias("distinct_offsets"))


query("scan_all", "SELECT n_nationkey, n_name FROM nation", "(scan all from nation) -> (project n_nationkey, n_name)", tables_=("nation",))
query("scan_range_incl_excl", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10 AND c_custkey <= 200", "(scan 10 excl to 200 incl from customer) -> (project c_custkey, c_name)", tables_=("customer",))
query("scan_open_range", "SELECT c_custkey FROM customer WHERE c_custkey < 75", "(scan start to 75 from customer) -> (project c_custkey)", tables_=("customer",))
query("scan_prefix_range", "SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey > 3 OR c_nationkey = 3 AND c_custkey >= 50) AND c_nationkey <= 7",
      "(scan 3, 50 to 7 incl from customer_by_nation) -> (project c_custkey, c_nationkey)", tables_=("customer_by_nation",))
query("scan_nulls_lowest", "SELECT s_suppkey FROM supplier WHERE CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey < 8 ELSE true END", "(scan start to 8 from supplier) -> (project s_suppkey)", tables_=("supplier",))
query("get_point", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7", "(get 7 from customer) -> (project c_custkey, c_name)", tables_=("customer",))
query("get_prefix", "SELECT c_custkey FROM customer WHERE c_nationkey = 5", "(get 5 from customer_by_nation) -> (project c_custkey)", tables_=("customer_by_nation",))
query("sort_multi_nulls", E + "SELECT event_id, kind, user_id FROM e", "(scan all from events) -> (project event_id, kind, user_id) -> (sort by kind desc, user_id, event_id)")
@built("sort_positions", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END s_group, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END DESC NULLS LAST, s_suppkey) - 1 p FROM supplier")
def sort_positions(spark, sf_dir):
    """The order itself: rows numbered as the sorted partitions lie."""
    rows = load(spark, sf_dir, None, "supplier").execute("(scan all from supplier) -> (project s_suppkey, s_group) -> (sort by s_group desc, s_suppkey)")
    return tables.with_offset(rows).select("s_suppkey", "s_group", F.col("offset").alias("p"))


@built("retention_at", "SELECT event_id FROM events WHERE epoch_us(ts) // 1000 + 864000000 > 1705104000000")
def retention_at(spark, sf_dir):
    """Rows of ten days, as they are on 13 January 2024."""
    return tables.retained(load(spark, sf_dir).stream("events").df, 864_000_000, F.timestamp_millis(F.lit(1705104000000))).select("event_id")


query("partition_repartition", E + "SELECT event_id, user_id FROM e", "p := events -> (partition by user_id partitions=16) -> (project event_id, user_id) -> (store stream)", "(scan all from p) -> (project event_id, user_id)")
query("partition_const", E + "SELECT count(*) n FROM e", "p := events -> (partition by const) -> (aggregate count(event_id) as n)", "(scan all from p) -> (project n)")
query("topic_bridge", "SELECT event_id \"offset\", event_type k, CAST(json_extract_string(props, '$.k') AS BIGINT) v FROM events",
      'b := (bridge from event_topic partitions = 16 props = ()) -> (project offset as o, to_string(key) as k, json_int("k", val) as v) -> (store stream)', "(scan all from b) -> (project offset, k, v)", tables_=("topic",))
query("child_pipelines", E + "SELECT event_type, count(*) n FROM e WHERE value > 10 GROUP BY event_type", "p := events -> (filter by value > 10f) -> (store stream)", "c := p -> (backfill) -> (aggregate count(event_id) as n by event_type)", "(scan all from c) -> (project event_type, n)")


@built("prepared_params", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 5 AND c_custkey < 25 AND c_nationkey <> 3")
def prepared_params(spark, sf_dir):
    engine = load(spark, sf_dir, None, "customer")
    engine.execute("prepare q := (scan $a:int to $b:int from customer) -> (filter by c_nationkey != $n:int) -> (project c_custkey, c_name)")
    return engine.execute_prepared("q", {"a": 5, "b": 25, "n": 3})


@built("list_streams", "SELECT * FROM (VALUES ('customer'), ('events')) v(stream_name)")
def list_streams(spark, sf_dir):
    return load(spark, sf_dir, None, "events", "customer", "nation").execute('list("^(cust|even)")')


@built("show_stream", "SELECT 'kept' stream_name, 'kept := events -> (filter by value > 1f) -> (store stream)' stream_def, 'stream' stored_as")
def show_stream(spark, sf_dir):
    engine = load(spark, sf_dir)
    engine.execute("kept := events -> (filter by value > 1f) -> (store stream)")
    return engine.execute("show(kept)").select("stream_name", "stream_def", "stored_as")


@built("udf_scalar", E + 'SELECT event_id, "user" * 2 + 1 twice, event_type || \'!\' loud FROM e')
def udf_scalar(spark, sf_dir):
    engine = load(spark, sf_dir)
    engine.register_module("mod", {"twice": (lambda x: 2 * x + 1, ["int"], "int"), "loud": (lambda s: s + "!", ["string"], "string")})
    return engine.execute("(scan all from events) -> (project event_id, mod.twice(user) as twice, mod.loud(event_type) as loud)")


query("kafka_headers", E + "SELECT event_id, event_type h1, CAST(NULL AS VARCHAR) h2, props h3 FROM e", 'h := events -> (project event_id, kafka_build_headers("a", event_type, "b", props) as hdrs) -> (store stream)',
      '(scan all from h) -> (project event_id, kafka_header("a", hdrs) as h1, kafka_header("none", hdrs) as h2, kafka_header("b", hdrs) as h3)')


@built("topic_compaction", E + 'SELECT event_id FROM e QUALIFY "user" IS NULL OR row_number() OVER (PARTITION BY "user" ORDER BY event_id DESC) = 1')
def topic_compaction(spark, sf_dir):
    return tables.compact(load(spark, sf_dir).stream("events").df, "user").select("event_id")


@built("row_delete", "SELECT c_custkey FROM customer WHERE c_nationkey <> 4")
def row_delete(spark, sf_dir):
    table = load(spark, sf_dir, None, "customer").stream("customer").df
    return tables.delete_rows(table, table.where("c_nationkey = 4"), ["c_custkey"]).select("c_custkey")


@built("offsets_by_time", "SELECT event_id % 4 \"partition\", min(event_id) \"offset\" FROM events WHERE epoch_us(ts) // 1000 >= 1704153600000 GROUP BY 1")
def offsets_by_time(spark, sf_dir):
    rows = load(spark, sf_dir).stream("events").df.withColumn("partition", F.col("event_id") % 4)
    return tables.offsets_by_time(rows, 1704153600000)


@built("producer_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def producer_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("producer_id"), F.col("event_type").alias("seq"), F.encode(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")), "UTF-8").alias("val"))
    kept = topics.without_resent(topics.as_topic(rows)).select(F.split(F.col("val").cast("string"), "/").alias("p"))
    return kept.select(F.col("p")[1].cast("bigint").alias("user_id"), F.col("p")[0].alias("event_type"))


@built("result_json_lines", "SELECT '[' || n_nationkey || ',\"' || n_name || '\"]' line FROM nation")
def result_json_lines(spark, sf_dir):
    return results.json_lines(load(spark, sf_dir, None, "nation").execute("(scan all from nation) -> (project n_nationkey, n_name)")).select("line")


# ---------------------------------------------------------------- streaming runs, to the end of the input


def _stream_root(spark) -> str:
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads a folder: the table's own, or the one that its file lies in
    rows = reader.parquet(path) if Folder(spark, path).is_folder() else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("event_time"), F.encode("event_type", "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("val"))


_TOP = "(SELECT max(epoch_us(ts) // 1000) FROM events)"


@built("stream_windowed", f"""WITH {EVENTS}, w AS (SELECT *, {_HOUR} * (1 + et // {_HOUR}) + k * {_HOUR} we FROM e, range(0, 4) r(k))
SELECT we w_end, event_type, count(*) n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) s FROM w WHERE we - {2 * _HOUR} <= et AND we <= {_TOP} - 1000 GROUP BY we, event_type""")  # fmt: skip
def stream_windowed(spark, sf_dir):
    engine = Engine(prepare(spark))
    engine.bind_topic("t", _event_stream(spark, sf_dir))
    engine.execute('s := (bridge from t partitions = 8 props = ()) -> (project to_string(key) as event_type, json_int("k", val) as k) -> (aggregate count(k) as n, sum(k) as s by event_type size=2h hop=1h window_cols=true)')
    runtime = Runtime(engine, _stream_root(spark))
    runtime.run("s")
    return runtime.snapshot().execute("(scan all from s) -> (project to_int(we) as w_end, event_type, n, s)")


@built("stream_table_upsert", "SELECT event_type, count(*) n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) s FROM events GROUP BY event_type")
def stream_table_upsert(spark, sf_dir):
    engine = Engine(prepare(spark))
    engine.bind_topic("t", _event_stream(spark, sf_dir))
    engine.execute('s := (bridge from t partitions = 8 props = ()) -> (project to_string(key) as event_type, json_int("k", val) as k) -> (aggregate count(k) as n, sum(k) as s by event_type)')
    runtime = Runtime(engine, _stream_root(spark))
    runtime.run("s")
    return runtime.snapshot().execute("(scan all from s) -> (project event_type, n, s)")


@built("stream_windows_unnamed", f"""WITH {EVENTS}, w AS (SELECT *, {24 * _HOUR} * (1 + et // {24 * _HOUR}) we FROM e)
SELECT event_type, max(et) et, count(*) n FROM w WHERE we <= {_TOP} - 1000 GROUP BY we, event_type""")  # fmt: skip
def stream_windows_unnamed(spark, sf_dir):
    engine = Engine(prepare(spark))
    engine.bind_topic("t", _event_stream(spark, sf_dir))
    engine.execute('s := (bridge from t partitions = 8 props = ()) -> (project to_string(key) as event_type) -> (aggregate count(event_type) as n by event_type size=24h hop=24h)')
    runtime = Runtime(engine, _stream_root(spark))
    runtime.run("s")
    return runtime.snapshot().execute("(scan all from s) -> (project event_type, to_int(event_time) as et, n)")


@built("stream_join_null_keys", """WITH s AS (SELECT event_id, epoch_us(ts) // 1000 et, event_type, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END k FROM events)
SELECT a.event_id x, b.event_id y FROM s a JOIN s b ON a.k IS NOT DISTINCT FROM b.k AND a.event_type = b.event_type AND abs(a.et - b.et) <= 60000""")  # fmt: skip
def stream_join_null_keys(spark, sf_dir):
    engine = Engine(prepare(spark))
    for name in "lr":
        engine.bind_topic(name + "t", _event_stream(spark, sf_dir))
        engine.execute(f'{name} := (bridge from {name}t partitions = 8 props = ()) -> (project to_string(key) as t, if(json_int("k", val) % 3 == 0, json_int("none", val), json_int("k", val)) as k, offset as id) -> (store stream)')
    engine.execute("j := (join l with r by k = k, t = t within 1m) -> (store stream)")
    runtime = Runtime(engine, _stream_root(spark))
    runtime.run("j")
    return runtime.snapshot().execute("(scan all from j) -> (project l_id as x, r_id as y)")


@built("stream_sent_topic", "SELECT event_id \"offset\", event_type k, props v FROM events")
def stream_sent_topic(spark, sf_dir):
    """What a topic sends on, caught in a folder in place of a broker."""
    engine, root = Engine(prepare(spark)), _stream_root(spark)
    engine.bind_topic("s", _event_stream(spark, sf_dir))
    engine.execute("s := (topic partitions = 8)")
    caught = lambda rows, options: rows.write.mode("append").parquet(f"{root}/sent/{options['topic']}")
    Runtime(engine, root, {"bootstrap.servers": "none"}, caught).run("s")
    return spark.read.parquet(f"{root}/sent/s").select("offset", F.col("key").cast("string").alias("k"), F.col("val").cast("string").alias("v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of events by type, in order."""
    engine = load(spark, sf_dir)
    engine.execute("w := events -> (aggregate count(value) as n, sum(value) as s, min(value) as lo, max(value) as hi, avg(value) as mean by event_type size=24h hop=24h window_cols=true)")
    return engine.execute("(scan all from w) -> (sort by ws, event_type)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


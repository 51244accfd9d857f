from decimal import Decimal as D

import pytest
from helpers import evaluate

from freshet.errors import StatementError

B = "a boolean, b boolean"


def test_boolean_nulls(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    assert evaluate(spark, "a && b", B, rows) == [True, False, None, False, False, None, None, None, None]
    assert evaluate(spark, "a || b", B, rows) == [True, True, True, True, False, None, None, None, None]


@pytest.mark.parametrize("condition", ["a && b", "a || b", "!a", "a && b || b", "a || b && a", "is_null(a) || b"])
def test_filter_condition_agrees_with_its_value(spark, condition):
    from freshet.engine import Engine

    engine = Engine(spark)
    engine.register_table("t", spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], B))
    kept = engine.execute(f"(scan all from t) -> (filter by {condition})").collect()
    valued = engine.execute(f"(scan all from t) -> (project a, b, {condition} as v)").collect()
    assert sorted(map(repr, (tuple(r) for r in kept))) == sorted(repr((r["a"], r["b"])) for r in valued if r["v"])


def test_filters_reach_the_scan(spark, tmp_path):
    from freshet.engine import Engine

    spark.range(10).selectExpr("id", "id % 3 AS k", "'x' AS wide").write.parquet(str(tmp_path / "t"))
    engine = Engine(spark)
    engine.register_table("t", spark.read.parquet(str(tmp_path / "t")))
    df = engine.execute("(scan all from t) -> (filter by id > 5 && k == 1) -> (project id)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "EqualTo(k,1)" in plan and "wide" not in plan.split("ReadSchema")[1]


def test_condition_functions(spark):
    rows = [(True,), (False,), (None,)]
    assert evaluate(spark, 'if(a, "y", "n")', "a boolean", rows) == ["y", "n", None]
    rows = [(1,), (2,), (9,), (None,)]
    assert evaluate(spark, 'case(x, 1, "one", 2, "two", "more")', "x long", rows) == ["one", "two", "more", None]
    assert evaluate(spark, "in(x, 1, 2)", "x long", rows) == [True, True, False, None]
    assert evaluate(spark, "in(x, y, 5)", "x long, y long", [(5, None), (4, None)]) == [True, False]
    assert evaluate(spark, "is_null(x)", "x long", rows) == [False, False, False, True]
    assert evaluate(spark, "is_not_null(x)", "x long", rows) == [True, True, True, False]


def test_arithmetic_groups_to_the_right(spark):
    assert evaluate(spark, "10 - 4 - 3") == 9
    assert evaluate(spark, "24 / 4 * 2") == 3
    assert evaluate(spark, "2 + 3 * 4") == 14
    assert evaluate(spark, "7 / 2") == 3
    assert evaluate(spark, "x / 2", "x long", [(-7,)]) == -3
    assert evaluate(spark, "x % 3", "x long", [(-7,)]) == -1
    assert evaluate(spark, "-3 + 1") == -2
    assert evaluate(spark, "abs(-5)") == 5
    assert evaluate(spark, "1.5f * 2f") == 3.0


@pytest.mark.parametrize("expression", ["1 / 0", "1 % 0", "1f / 0f", 'to_int("abc")', 'parse_date("x", "2006-01-02")'])
def test_errors_fail_the_statement(spark, expression):
    with pytest.raises(Exception, match="(?i)divi|cast|pars"):
        evaluate(spark, expression)


@pytest.mark.parametrize(("expression", "message"), [
    ("1 + 1f", "doesn't take int and float"), ("true > false", "doesn't take"), ("1f % 2f", "doesn't take"), ("y", "unknown column"), ("nothing(1)", "unknown function"), ("len(1)", "argument 1 is of type int"),
    ('if(1, 2, 3)', "argument 1"), ("if(true, 1, 2f)", "differ"), ('matches("a", "(")', "regular expression"), ("in(1, 2)", "3 or more"), ("1.5", "floats end in f"), ('"a" && true', "doesn't take"), ("to_decimal(1, 40, 2)", "precision"),
])
def test_types_are_strict(spark, expression, message):
    with pytest.raises(StatementError, match=message):
        evaluate(spark, expression)


def test_error_points_at_its_place(spark):
    with pytest.raises(StatementError) as e:
        evaluate(spark, "1 +\n  nope")
    assert "line 2 column 3" in str(e.value) and str(e.value).endswith("  ^")


def dec(spark, expression, a, b, ta="decimal(10,2)", tb="decimal(10,2)"):
    return evaluate(spark, expression, f"a {ta}, b {tb}", [(a and D(a), b and D(b))])


def test_decimals_carry_no_digit(spark):
    assert dec(spark, "a + b", "1.25", "2.5", tb="decimal(12,1)") == D("3.75")
    assert dec(spark, "a * b", "1.25", "2.50") == D("3.1250")
    assert dec(spark, "a / b", "2.00", "3.00") == D("0.66")
    assert dec(spark, "a / b", "-2.00", "3.00") == D("-0.66")
    assert dec(spark, "a / b", "2.000000", "3.000000", "decimal(38,6)", "decimal(38,6)") == D("0.666666")
    assert dec(spark, "a + b", None, "1") is None
    with pytest.raises(Exception, match="(?i)numeric|overflow|range"):
        dec(spark, "a + b", "99999999.99", "0.01")
    assert dec(spark, "to_int(a)", "-1.50", None) == -2
    assert evaluate(spark, "to_int(x)", "x double", [(-1.5,)]) == -1
    assert dec(spark, "decimal_shift(a, 1)", "1.25", None) == D("12.50")
    assert dec(spark, "decimal_shift(a, -1)", "1.26", None) == D("0.13")
    assert dec(spark, "decimal_shift(a, -1, false)", "-1.26", None) == D("-0.12")


def test_strings_by_bytes(spark):
    s = "x string"
    assert evaluate(spark, "len(x)", s, [("Åb",)]) == 3
    assert evaluate(spark, "sub_str(x, 2, 3)", s, [("Åb",)]) == "b"
    rows = [("hello",), (None,)]
    assert evaluate(spark, "sub_str(x, 1, 3)", s, rows) == ["el", None]
    assert evaluate(spark, "sub_str(x, -4, 99)", s, rows)[0] == "hello"
    assert [evaluate(spark, f"sub_str(x, {a}, {b})", s, rows)[0] for a, b in ((9, 12), (3, 1), (0, -1))] == ["", "", ""]
    assert evaluate(spark, 'trim(x, "ho")', s, rows)[0] == "ell"
    assert evaluate(spark, 'ltrim(x, "he")', s, rows)[0] == "llo"
    assert evaluate(spark, 'rtrim(x, "lo")', s, rows)[0] == "he"
    assert evaluate(spark, 'replace(x, "l", "LL")', s, rows)[0] == "heLLLLo"
    assert evaluate(spark, 'replace(x, "", "-")', s, [("ab",)]) == "-a-b-"
    assert evaluate(spark, 'concat(x, "!")', s, rows) == ["hello!", None]
    assert evaluate(spark, 'matches(x, "l+")', s, rows) == [True, None]
    assert evaluate(spark, 'starts_with(x, "he") && ends_with(x, "lo")', s, rows) == [True, None]
    assert evaluate(spark, "to_upper(x)", s, rows)[0] == "HELLO"


def test_to_string_of_floats(spark):
    values = [(10000000.0,), (1.5,), (0.0001,), (1e21,), (-2.0,), (123456789.125,), (float("nan"),), (1e-7,)]
    assert evaluate(spark, "to_string(x)", "x double", values) == ["10000000", "1.5", "0.0001", "1000000000000000000000", "-2", "123456789.125", "NaN", "0.0000001"]


def test_sprintf(spark):
    row = [("b", 5, 1.5, None)]
    schema = "s string, i long, f double, n long"
    assert evaluate(spark, 'sprintf("%s-%d", s, i)', schema, row) == "b-5"
    assert evaluate(spark, 'sprintf("%5.2f|%-4s|%04d|%x|%v|%t", f, s, i, i, f, true)', schema, row) == " 1.50|b   |0005|5|1.5|true"
    assert evaluate(spark, 'sprintf("%d %v %q", n, n, s)', schema, row) == '%!d(<nil>) <nil> "b"'


def test_dates(spark):
    assert evaluate(spark, 'to_int(parse_date("2008-04-03 23:21:17.123", "2006-01-02 15:04:05.999999"))') == 1207264877123
    assert evaluate(spark, 'to_int(parse_date("2008-04-03 23:21:17", "2006-01-02 15:04:05.999"))') == 1207264877000
    assert evaluate(spark, 'format_date(to_timestamp(1207264877120), "Mon, 2 Jan 2006 03:04:05.000 PM")') == "Thu, 3 Apr 2008 11:21:17.120 PM"
    assert evaluate(spark, 'format_date(to_timestamp(1207264877120), "15:04:05.999")') == "23:21:17.12"
    assert evaluate(spark, 'format_date(to_timestamp(1207264877000), "15:04:05.999")') == "23:21:17"
    parts = ", ".join
    t = "to_timestamp(1207264877123)"
    assert [evaluate(spark, f"{f}({t})") for f in ("year", "month", "day", "hour", "minute", "second", "millis")] == [2008, 4, 3, 23, 21, 17, 123]
    assert parts
    assert evaluate(spark, "to_int(now()) > 1700000000000") is True


DOC = '{"a":{"b":[1,{"c":"x y"}]},"n":null,"t":true,"f":1.75,"s":"12","o":{"z": 1}}'


@pytest.mark.parametrize(("expression", "value"), [
    ('json_int("a.b.0", j)', 1), ('json_string("a.b.1.c", j)', "x y"), ('json_int("n", j)', None), ('json_int("none", j)', None), ('json_int("f", j)', 1), ('json_float("f", j)', 1.75), ('json_bool("t", j)', True), ('json_int("s", j)', 12),
    ('json_raw("a.b.1.c", j)', '"x y"'), ('json_raw("o", j)', '{"z": 1}'), ('json_raw("none", j)', None), ('json_is_null("n", j)', True), ('json_is_null("t", j)', False), ('json_is_null("none", j)', None),
    ('json_type("n", j)', "null"), ('json_type("t", j)', "bool"), ('json_type("f", j)', "number"), ('json_type("s", j)', "string"), ('json_type("o", j)', "json"), ('json_type("none", j)', None), ('json_int("a.b.0", to_bytes(j))', 1),
])
def test_json(spark, expression, value):
    assert evaluate(spark, expression, "j string", [(DOC,)]) == value


def test_bytes_and_headers(spark):
    raw = [(bytearray(range(1, 17)),)]
    assert evaluate(spark, "uint64_be(b, 0)", "b binary", raw) == int.from_bytes(range(1, 9), "big")
    assert evaluate(spark, "uint64_le(b, 8)", "b binary", raw) == int.from_bytes(range(9, 17), "little")
    assert evaluate(spark, "uint64_be(b, 9)", "b binary", raw) is None
    assert evaluate(spark, "uint64_be(b, 0)", "b binary", [(bytearray(b"\xff" * 8),)]) == -1
    assert bytes(evaluate(spark, "bytes_slice(b, 2, 4)", "b binary", raw)) == b"\x03\x04"
    made = 'kafka_build_headers("h1", "v1", "h2", x)'
    assert evaluate(spark, f'kafka_header("h1", {made})', "x string", [(None,)]) == "v1"
    assert evaluate(spark, f'kafka_header("h2", {made})', "x string", [(None,)]) == ""
    assert evaluate(spark, f'kafka_header("h3", {made})', "x string", [("a",)]) is None


def test_user_modules(spark):
    from freshet.engine import Engine

    engine = Engine(spark)
    engine.register_table("t", spark.createDataFrame([(1,), (None,)], "x long").coalesce(1))
    engine.register_module("m", {"plus": (lambda a, b: a + b, ["int", "int"], "int")})
    assert [r[0] for r in engine.execute("(scan all from t) -> (project m.plus(x, 2) as v)").collect()] == [3, None]
    with pytest.raises(StatementError, match="argument 2 is of type float"):
        engine.execute("(scan all from t) -> (project m.plus(x, 2f) as v)")
    engine.unregister_module("m")
    with pytest.raises(StatementError, match="unknown function"):
        engine.execute("(scan all from t) -> (project m.plus(x, 2) as v)")

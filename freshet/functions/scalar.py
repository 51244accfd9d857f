"""The 48 built-in functions, each a typed rewrite to Spark columns.

A null argument makes the result null unless a function says otherwise.  Everything stays in generated code except
``json_raw``, ``sprintf`` beyond plain verbs and the header codec, which run over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StatementError
from ..types import BOOL, BYTES, FLOAT, INT, STRING, TIMESTAMP, Kind, decimal, from_millis, to_millis
from . import layouts, rowwise


@dataclass(frozen=True)
class Typed:
    """A typed expression; ``const`` is the value of a literal, ``col`` of None a bare constant."""

    col: Column
    kind: Kind
    const: object = field(default=None, compare=False)
    nullable: bool = True


FUNCTIONS: dict[str, Callable[..., Typed]] = {}


def function(name: str, least: int, most: int | None = None):
    def register(build):
        def checked(args: list[Typed]) -> Typed:
            if len(args) < least or most is not None and len(args) > most or most is None and least < 0:
                wanted = str(least) if most == least else f"{least} or more" if most is None else f"{least} to {most}"
                raise StatementError(f"function {name!r} takes {wanted} arguments, not {len(args)}")
            return build(*args)

        FUNCTIONS[name] = checked
        return build

    return register


def want(name: str, position: int, arg: Typed, *kinds: str) -> None:
    if arg.kind.name not in kinds:
        raise StatementError(f"function {name!r}: argument {position} is of type {arg.kind}, not {' or '.join(kinds)}")


def literal(name: str, position: int, arg: Typed):
    if arg.const is None:
        raise StatementError(f"function {name!r}: argument {position} has to be a literal")
    return arg.const


def same(name: str, args: list[Typed]) -> Kind:
    if len({a.kind for a in args}) > 1:
        raise StatementError(f"function {name!r}: types {', '.join(str(a.kind) for a in args)} differ")
    return args[0].kind


# ---------------------------------------------------------------- conditions


@function("if", 3, 3)
def _if(test, yes, no):
    want("if", 1, test, "bool")
    kind = same("if", [yes, no])
    return Typed(F.when(test.col, yes.col).when(~test.col, no.col), kind)  # a null test matches neither


@function("is_null", 1, 1)
def _is_null(x):
    return Typed(x.col.isNull(), BOOL, nullable=False)


@function("is_not_null", 1, 1)
def _is_not_null(x):
    return Typed(x.col.isNotNull(), BOOL, nullable=False)


@function("in", 3)
def _in(x, *items):
    same("in", [x, *items])
    return Typed(F.when(x.col.isNotNull(), F.coalesce(x.col.isin([i.col for i in items]), F.lit(False))), BOOL)


@function("case", 4)
def _case(x, *rest):
    if len(rest) % 2 == 0:
        raise StatementError("function 'case' takes an even number of arguments: a test, pairs of value and result, a default")
    tests, results = rest[:-1:2], [*rest[1:-1:2], rest[-1]]
    same("case", [x, *tests])
    kind = same("case", results)
    out = F.when(x.col.isNull(), F.lit(None))
    for test, result in zip(tests, results, strict=False):
        out = out.when(x.col == test.col, result.col)
    return Typed(out.otherwise(results[-1].col), kind)


# ---------------------------------------------------------------- decimals and numbers


@function("decimal_shift", 2, 3)
def _decimal_shift(d, places, rounded=None):
    want("decimal_shift", 1, d, "decimal")
    want("decimal_shift", 2, places, "int")
    if rounded is not None:
        want("decimal_shift", 3, rounded, "bool")
    p, s = d.kind.precision, d.kind.scale
    n = places.const
    if n is None:
        raise StatementError("function 'decimal_shift': the number of places has to be a literal")
    n = int(n)
    half = rounded is None or rounded.const is True
    if n >= 0:
        moved = d.col.cast(f"decimal(38,{s})") * F.lit(10**n).cast("decimal(38,0)") if n < 38 else None
        if moved is None:
            raise StatementError("function 'decimal_shift': too many places")
        return Typed(moved.cast(d.kind.spark), d.kind)
    wide = min(38, s - n)
    divided = (d.col.cast(f"decimal(38,{s})") / F.lit(10**-n).cast("decimal(38,0)")).cast(f"decimal(38,{wide})")
    return Typed((divided if half else truncated(divided, s)).cast(d.kind.spark), d.kind)


def truncated(col: Column, scale: int) -> Column:
    """Towards zero at ``scale`` digits."""
    unit = F.lit(10**scale).cast("decimal(38,0)")
    return (F.signum(col).cast("decimal(1,0)") * F.floor(F.abs(col) * unit)) / unit


@function("abs", 1, 1)
def _abs(x):
    want("abs", 1, x, "int", "float", "decimal")
    return Typed(F.abs(x.col), x.kind)


# ---------------------------------------------------------------- strings, by bytes


@function("len", 1, 1)
def _len(x):
    want("len", 1, x, "string", "bytes")
    return Typed(F.octet_length(x.col).cast("long"), INT)


@function("concat", 2, 2)
def _concat(a, b):
    want("concat", 1, a, "string", "bytes")
    return Typed(F.concat(a.col, b.col), same("concat", [a, b]))


def _two_strings(name, build, kind=BOOL):
    @function(name, 2, 2)
    def run(s, t):
        want(name, 1, s, "string")
        want(name, 2, t, "string")
        return Typed(build(s.col, t.col), kind)


_two_strings("starts_with", lambda s, t: F.startswith(s, t))
_two_strings("ends_with", lambda s, t: F.endswith(s, t))
_two_strings("trim", lambda s, t: F.btrim(s, t), STRING)
_two_strings("ltrim", lambda s, t: F.ltrim(s, t), STRING)
_two_strings("rtrim", lambda s, t: F.rtrim(s, t), STRING)


@function("matches", 2, 2)
def _matches(s, pattern):
    want("matches", 1, s, "string")
    want("matches", 2, pattern, "string")
    text = literal("matches", 2, pattern)
    try:
        re.compile(re.sub(r"\\[pPQEzG]|\(\?[a-zA-Z-]*[U]|\[\[:\^?\w+:\]\]", "x", text))
    except re.error as bad:
        raise StatementError(f"function 'matches': {text!r} is not a regular expression: {bad}") from None
    return Typed(s.col.rlike(re.sub(r"\[:(\^?)(\w+):\]", lambda m: ("\\P" if m[1] else "\\p") + "{" + m[2].capitalize() + "}", text)), BOOL)


@function("to_lower", 1, 1)
def _to_lower(s):
    want("to_lower", 1, s, "string")
    return Typed(F.lower(s.col), STRING)


@function("to_upper", 1, 1)
def _to_upper(s):
    want("to_upper", 1, s, "string")
    return Typed(F.upper(s.col), STRING)


def _slice(data: Column, start: Column, end: Column, blank: Column) -> Column:
    size = F.octet_length(data)
    low, high = F.greatest(start, F.lit(0)), F.least(end, size.cast("long"))
    nothing = (end < 0) | (start > size) | (start > end)
    cut = F.substring(data, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    known = data.isNotNull() & start.isNotNull() & end.isNotNull()
    return F.when(known & nothing, blank).when(known, cut)


@function("sub_str", 3, 3)
def _sub_str(s, start, end):
    want("sub_str", 1, s, "string")
    want("sub_str", 2, start, "int")
    want("sub_str", 3, end, "int")
    data = F.encode(s.col, "UTF-8")
    return Typed(_slice(data, start.col, end.col, F.lit(bytearray())).cast("string"), STRING)


@function("bytes_slice", 3, 3)
def _bytes_slice(b, start, end):
    want("bytes_slice", 1, b, "bytes")
    want("bytes_slice", 2, start, "int")
    want("bytes_slice", 3, end, "int")
    return Typed(_slice(b.col, start.col, end.col, F.lit(bytearray())), BYTES)


@function("replace", 3, 3)
def _replace(s, old, new):
    for k, a in enumerate((s, old, new), 1):
        want("replace", k, a, "string")
    between = F.concat(F.regexp_replace(s.col, "(?s)(.)", F.concat(F.regexp_replace(new.col, r"([\\$])", r"\\$1"), F.lit("$1"))), new.col)
    return Typed(F.when(old.col == "", between).otherwise(F.replace(s.col, old.col, new.col)), STRING)


@function("sprintf", 2)
def _sprintf(template, *args):
    want("sprintf", 1, template, "string")
    shown = [Typed(a.col.cast("string"), STRING) if a.kind.name == "decimal" else Typed(to_millis(a.col), INT) if a.kind == TIMESTAMP else a for a in args]
    plain = template.const is not None and re.fullmatch(r"(?:[^%]|%%|%[sdvt])*", template.const)
    verbs = re.findall(r"%([sdvt])", template.const.replace("%%", "")) if plain else []
    fits = {"string": "sv", "int": "dv", "bool": "tv"}
    if plain and len(verbs) == len(shown) and all(v in fits.get(a.kind.name, "") for v, a in zip(verbs, shown, strict=True)):
        texts = [F.coalesce(a.col.cast("string"), F.lit("<nil>" if v == "v" else f"%!{v}(<nil>)")) for v, a in zip(verbs, shown, strict=True)]
        pieces = [F.lit(p.replace("\0", "%")) for p in re.split(r"%[sdvt]", template.const.replace("%%", "\0"))]
        mixed = [pieces[0]]
        for text, piece in zip(texts, pieces[1:], strict=True):
            mixed += [text, piece]
        return Typed(F.concat(*mixed), STRING)
    row = F.struct(template.col.alias("f"), *[a.col.alias(f"v{k}") for k, a in enumerate(shown)])
    return Typed(rowwise.sprintf([a.kind.name for a in shown])(row), STRING)


# ---------------------------------------------------------------- casts


@function("to_int", 1, 1)
def _to_int(x):
    want("to_int", 1, x, "int", "float", "decimal", "string", "timestamp")
    if x.kind.name == "decimal":
        return Typed(F.floor(x.col).cast("long"), INT)
    if x.kind == STRING:
        return Typed(F.coalesce(x.col.try_cast("bigint"), x.col.cast("double").cast("bigint")), INT)
    return Typed(to_millis(x.col) if x.kind == TIMESTAMP else x.col.cast("bigint"), INT)


@function("to_float", 1, 1)
def _to_float(x):
    want("to_float", 1, x, "int", "float", "decimal", "string", "timestamp")
    return Typed((to_millis(x.col) if x.kind == TIMESTAMP else x.col).cast("double"), FLOAT)


def float_text(x: Column) -> Column:
    """Shortest digits without an exponent."""
    text = F.abs(x).cast("string")
    mantissa = F.regexp_extract(text, r"^([0-9.]+)", 1)
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(2)), "^0$", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.concat(whole, part)
    up = F.when(F.length(digits) <= exponent + 1, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    spread = F.when(exponent.isNull(), F.regexp_replace(text, r"\.0$", "")).when(exponent >= 0, up).otherwise(down)
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(F.concat(sign, spread))


@function("to_string", 1, 1)
def _to_string(x):
    if x.kind == FLOAT:
        return Typed(F.when(x.col.isNotNull(), float_text(x.col)), STRING)
    return Typed(to_millis(x.col).cast("string") if x.kind == TIMESTAMP else x.col.cast("string"), STRING)


@function("to_decimal", 3, 3)
def _to_decimal(x, p, s):
    want("to_decimal", 1, x, "int", "float", "decimal", "string", "timestamp")
    kind = decimal(int(literal("to_decimal", 2, p)), int(literal("to_decimal", 3, s)))
    return Typed((to_millis(x.col) if x.kind == TIMESTAMP else x.col).cast(kind.spark), kind)


@function("to_bytes", 1, 1)
def _to_bytes(x):
    want("to_bytes", 1, x, "string", "bytes")
    return Typed(F.encode(x.col, "UTF-8") if x.kind == STRING else x.col, BYTES)


@function("to_timestamp", 1, 1)
def _to_timestamp(x):
    want("to_timestamp", 1, x, "int", "timestamp")
    return Typed(from_millis(x.col) if x.kind == INT else x.col, TIMESTAMP)


# ---------------------------------------------------------------- dates, UTC


@function("format_date", 2, 2)
def _format_date(t, layout):
    want("format_date", 1, t, "timestamp")
    want("format_date", 2, layout, "string")
    pattern, cut = layouts.pattern(literal("format_date", 2, layout), parsing=False)
    text = F.date_format(t.col, pattern)
    return Typed(F.regexp_replace(text, r"([.,]\d*?)0+(?!\d)", "$1") if cut and pattern.rstrip("S")[-1:] not in ".," else F.regexp_replace(text, r"[.,]?0*$", "") if cut and pattern.endswith("S") else text, STRING)


@function("parse_date", 2, 2)
def _parse_date(s, layout):
    want("parse_date", 1, s, "string")
    want("parse_date", 2, layout, "string")
    pattern, _ = layouts.pattern(literal("parse_date", 2, layout), parsing=True)
    return Typed(F.date_trunc("millisecond", F.to_timestamp(s.col, pattern)), TIMESTAMP)


def _date_part(name, build):
    @function(name, 1, 1)
    def run(t):
        want(name, 1, t, "timestamp")
        return Typed(build(t.col).cast("long"), INT)


for _name, _build in {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "millis": lambda t: F.pmod(to_millis(t), F.lit(1000))}.items():
    _date_part(_name, _build)


@function("now", 0, 0)
def _now():
    return Typed(F.date_trunc("millisecond", F.current_timestamp()), TIMESTAMP, nullable=False)


# ---------------------------------------------------------------- JSON


def path_steps(path: str) -> list[str]:
    steps = [re.sub(r"\\(.)", r"\1", x) for x in re.findall(r"((?:[^.\\]|\\.)+)", path)]
    if not steps or re.search(r"(?<!\\)[#*?|@!{}\[\]]", path):
        raise StatementError(f"JSON path {path!r} is not supported: names and positions joined by dots are")
    return steps


def _paths(steps: list[str]) -> list[str]:
    """A number may be a position or a name: every reading, the positions first."""
    out = ["$"]
    for step in steps:
        named = "['" + step.replace("'", "\\'") + "']"
        out = [o + r for o in out for r in ([f"[{step}]", named] if step.isdigit() else [named])]
    return out


def _json(name, path, doc):
    want(name, 1, path, "string")
    want(name, 2, doc, "string", "bytes")
    steps = path_steps(literal(name, 1, path))
    text = doc.col.cast("string") if doc.kind == BYTES else doc.col
    return steps, text


def _extracted(name, path, doc) -> Column:
    steps, text = _json(name, path, doc)
    found = [F.get_json_object(text, p) for p in _paths(steps)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def _variant(name, path, doc) -> Column:
    steps, text = _json(name, path, doc)
    parsed = F.try_parse_json(text)
    found = [F.try_variant_get(parsed, p, "variant") for p in _paths(steps)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


@function("json_int", 2, 2)
def _json_int(path, doc):
    s = _extracted("json_int", path, doc)
    number = F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))
    return Typed(F.when(s.isNotNull(), F.coalesce(number, F.when(s == "true", F.lit(1)).otherwise(F.lit(0)).cast("bigint"))), INT)


@function("json_float", 2, 2)
def _json_float(path, doc):
    s = _extracted("json_float", path, doc)
    return Typed(F.when(s.isNotNull(), F.coalesce(s.try_cast("double"), F.when(s == "true", F.lit(1.0)).otherwise(F.lit(0.0)))), FLOAT)


@function("json_bool", 2, 2)
def _json_bool(path, doc):
    s = _extracted("json_bool", path, doc)
    truth = F.lower(s).isin("1", "t", "true")
    return Typed(F.when(s.isNotNull(), truth | F.coalesce(s.try_cast("double") != 0, F.lit(False))), BOOL)


@function("json_string", 2, 2)
def _json_string(path, doc):
    return Typed(_extracted("json_string", path, doc), STRING)


@function("json_raw", 2, 2)
def _json_raw(path, doc):
    steps, text = _json("json_raw", path, doc)
    return Typed(rowwise.json_raw(steps)(text), STRING)


@function("json_is_null", 2, 2)
def _json_is_null(path, doc):
    found = _variant("json_is_null", path, doc)
    return Typed(F.when(found.isNotNull(), F.is_variant_null(found)), BOOL)


@function("json_type", 2, 2)
def _json_type(path, doc):
    found = _variant("json_type", path, doc)
    name = F.schema_of_variant(found)
    kind = F.when(name == "VOID", "null").when(name == "BOOLEAN", "bool").when(name == "STRING", "string").when(name.rlike("^(OBJECT|ARRAY)"), "json").otherwise("number")
    return Typed(F.when(found.isNotNull(), kind), STRING)


# ---------------------------------------------------------------- headers and bytes


@function("kafka_build_headers", 2)
def _kafka_build_headers(*args):
    if len(args) % 2:
        raise StatementError("function 'kafka_build_headers' takes pairs of name and value")
    for k, a in enumerate(args, 1):
        want("kafka_build_headers", k, a, "string", "bytes")
    return Typed(rowwise.build_headers(F.struct(*[a.col.alias(f"v{k}") for k, a in enumerate(args)])), BYTES)


@function("kafka_header", 2, 2)
def _kafka_header(name, headers):
    want("kafka_header", 1, name, "string")
    want("kafka_header", 2, headers, "bytes")
    return Typed(rowwise.header_value(name.col, headers.col).cast("string"), STRING)


def _uint64(name, little):
    @function(name, 2, 2)
    def run(data, position):
        want(name, 1, data, "bytes")
        want(name, 2, position, "int")
        piece = F.substring(data.col, (position.col + 1).cast("int"), F.lit(8))
        if little:
            piece = F.concat(*[F.substring(data.col, (position.col + k).cast("int"), F.lit(1)) for k in range(8, 0, -1)])
        fits = (position.col >= 0) & (position.col + 8 <= F.octet_length(data.col))
        return Typed(F.when(fits, F.conv(F.hex(piece), 16, -10).cast("bigint")), INT)


_uint64("uint64_be", False)
_uint64("uint64_le", True)

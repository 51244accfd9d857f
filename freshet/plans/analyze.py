"""Typed Spark columns of expression trees.

Types are strict: nothing is cast unasked.  Booleans follow the language: a null on either side of ``&&`` makes it
null, ``||`` is null where the left side is, and where the left is false and the right null.  For the condition of
a filter, which drops nulls anyway, ``truth`` gives an equivalent of plain AND and OR that Catalyst can push to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StatementError
from ..functions.modules import Modules
from ..functions.scalar import FUNCTIONS, Typed
from ..types import BOOL, FLOAT, INT, STRING, TIMESTAMP, Kind, decimal, from_millis, kind_of, parse_kind, to_millis
from . import ast as A

_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def scope_of(schema) -> dict[str, Typed]:
    return {f.name: Typed(F.col(f"`{f.name}`"), kind_of(f.dataType), nullable=f.nullable) for f in schema}


class Analyzer:
    def __init__(self, scope: Mapping[str, Typed], modules: Modules | None = None, text: str = "", params: Mapping[str, object] | None = None):
        self.scope, self.modules, self.text, self.params = scope, modules or Modules(), text, params

    def typed(self, node) -> Typed:
        try:
            return self._typed(node)
        except StatementError as e:
            if e.at is None and self.text and getattr(node, "at", -1) >= 0:
                raise StatementError(e.message, self.text, node.at) from None
            raise

    def _typed(self, node) -> Typed:
        if isinstance(node, A.Literal):
            return Typed(F.lit(node.value).cast("bigint") if node.kind == "int" else F.lit(node.value), Kind(node.kind), node.value, nullable=False)
        if isinstance(node, A.Name):
            if node.name not in self.scope:
                raise StatementError(f"unknown column {node.name!r}; there are {', '.join(self.scope)}", self.text, node.at if node.at >= 0 else None)
            return self.scope[node.name]
        if isinstance(node, A.Param):
            kind = parse_kind(node.kind)
            value = None if self.params is None else self.params.get(node.name)
            return Typed(bind(value, kind), kind, value)
        if isinstance(node, A.Unary):
            arg = self.typed(node.arg)
            if arg.kind != BOOL:
                raise StatementError(f"operator '!' takes bool, not {arg.kind}", self.text, node.at)
            return Typed(~arg.col, BOOL, nullable=arg.nullable)
        if isinstance(node, A.Binary):
            return self.binary(node)
        if isinstance(node, A.Call):
            if node.name in self.modules:
                return self.modules.call(node.name, [self.typed(a) for a in node.args])
            if node.name not in FUNCTIONS:
                raise StatementError(f"unknown function {node.name!r}", self.text, node.at)
            return FUNCTIONS[node.name]([self.typed(a) for a in node.args])
        raise StatementError(f"not an expression: {node!r}")

    def binary(self, node: A.Binary) -> Typed:
        left, right = self.typed(node.left), self.typed(node.right)
        op, nullable = node.op, left.nullable or right.nullable
        a, b = left.col, right.col

        def wrong():
            return StatementError(f"operator {op!r} doesn't take {left.kind} and {right.kind}", self.text, node.at)

        if left.kind.name != right.kind.name:
            raise wrong()
        name = left.kind.name
        if op in ("&&", "||"):
            if name != "bool":
                raise wrong()
            if not nullable:
                return Typed(a & b if op == "&&" else a | b, BOOL, nullable=False)
            if op == "&&":
                return Typed(F.when(a.isNotNull() & b.isNotNull(), a & b), BOOL)
            return Typed(F.when(a, True).when(~a, b), BOOL)
        if op in _COMPARE:
            if name == "bool" and op not in ("==", "!="):
                raise wrong()
            return Typed(_COMPARE[op](a, b), BOOL, nullable=nullable)
        if op == "%":
            if name != "int":
                raise wrong()
            return Typed(a % b, INT, nullable=nullable)
        if name == "timestamp":
            sums = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.call_function("div", x, y)}
            return Typed(from_millis(sums[op](to_millis(a), to_millis(b)).cast("bigint")), TIMESTAMP, nullable=nullable)
        if name == "decimal":
            return decimal_result(op, left, right, nullable)
        if name not in ("int", "float"):
            raise wrong()
        if op == "/":
            return Typed(F.call_function("div", a, b) if name == "int" else a / b, left.kind, nullable=nullable)
        return Typed(a + b if op == "+" else a - b if op == "-" else a * b, left.kind, nullable=nullable)

    def truth(self, node) -> Column:
        """A condition that is true exactly where the expression is; elsewhere false or null."""
        if isinstance(node, A.Binary) and node.op in ("&&", "||"):
            if any(self.typed(x).kind != BOOL for x in (node.left, node.right)):
                self.typed(node)
            a, b = self.truth(node.left), self.truth(node.right)
            if node.op == "&&":
                return a & b
            left = self.typed(node.left)
            return a | b if not left.nullable else a | (left.col.isNotNull() & b)
        found = self.typed(node)
        if found.kind != BOOL:
            raise StatementError(f"a filter takes an expression of type bool, not {found.kind}", self.text, getattr(node, "at", None))
        return found.col


def decimal_result(op: str, left: Typed, right: Typed, nullable: bool) -> Typed:
    """No digit is carried: sums have the larger precision and scale, products add the scales, quotients are cut."""
    (p1, s1), (p2, s2) = (left.kind.precision, left.kind.scale), (right.kind.precision, right.kind.scale)
    a, b = left.col, right.col
    if op in "+-":
        kind = decimal(max(p1, p2), max(s1, s2))
        return Typed((a + b if op == "+" else a - b).cast(kind.spark), kind, nullable=nullable)
    if op == "*":
        kind = decimal(max(p1, p2), s1 + s2)
        return Typed((a * b).cast(kind.spark), kind, nullable=nullable)
    # exact and cut towards zero: the whole part, then the remainder's next s1 digits
    unit = F.lit(10**s1).cast(f"decimal({s1 + 1},0)")
    whole, rest = F.call_function("div", a, b), a % b
    digits = F.call_function("div", rest * unit, b)
    cut = whole.cast("decimal(38,0)").cast(left.kind.spark) + (digits.cast(f"decimal({s1 + 1},0)") / unit).cast(left.kind.spark)
    return Typed(cut.cast(left.kind.spark), left.kind, nullable=nullable)


def bind(value, kind: Kind) -> Column:
    """A typed literal of a prepared query's argument; None is a null."""
    if value is None:
        return F.lit(None).cast(kind.spark)
    if kind == TIMESTAMP and isinstance(value, int):
        return from_millis(F.lit(value).cast("bigint"))
    if kind == INT and (isinstance(value, bool) or not isinstance(value, int)) or kind == FLOAT and not isinstance(value, (int, float)) or kind == STRING and not isinstance(value, str):
        raise StatementError(f"argument {value!r} is not of type {kind}")
    return F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(kind.spark)

"""User modules: named functions with fixed types, run over Arrow batches; any null argument makes the result null."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F

from ..errors import StatementError
from ..types import Kind, parse_kind
from .scalar import Typed


class Modules:
    def __init__(self):
        self._functions: dict[str, tuple[Callable, list[Kind], Kind]] = {}

    def register(self, module: str, functions: dict[str, tuple[Callable, list[str], str]]) -> None:
        """``functions``: name to (callable of one row's values, parameter types, result type)."""
        if any(name.startswith(f"{module}.") for name in self._functions):
            raise StatementError(f"module {module!r} is registered already")
        for name, (call, params, result) in functions.items():
            self._functions[f"{module}.{name}"] = (call, [parse_kind(p) for p in params], parse_kind(result))

    def unregister(self, module: str) -> None:
        gone = [name for name in self._functions if name.startswith(f"{module}.")]
        if not gone:
            raise StatementError(f"module {module!r} isn't registered")
        for name in gone:
            del self._functions[name]

    def __contains__(self, name: str) -> bool:
        return name in self._functions

    def call(self, name: str, args: list[Typed]) -> Typed:
        call, params, result = self._functions[name]
        if len(args) != len(params):
            raise StatementError(f"function {name!r} takes {len(params)} arguments, not {len(args)}")
        for k, (arg, kind) in enumerate(zip(args, params, strict=True), 1):
            if arg.kind != kind and not (arg.kind.name == kind.name == "decimal"):
                raise StatementError(f"function {name!r}: argument {k} is of type {arg.kind}, not {kind}")
        run = F.udf(call, result.spark, useArrow=True)(*[a.col for a in args])
        if not args:
            return Typed(run, result)
        known = functools.reduce(lambda a, b: a & b, [a.col.isNotNull() for a in args])
        safe = F.udf(lambda *values: None if any(v is None for v in values) else call(*values), result.spark, useArrow=True)
        return Typed(F.when(known, safe(*[a.col for a in args])), result)

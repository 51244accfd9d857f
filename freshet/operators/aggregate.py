"""Continuous and windowed aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatementError
from ..functions.scalar import Typed
from ..plans import ast as A
from ..types import FLOAT, INT, TIMESTAMP, Kind, decimal, from_millis, to_millis
from .rows import analyzer

_TAKES = {"sum": ("int", "float", "decimal"), "avg": ("int", "float", "decimal", "timestamp"), "min": ("int", "float", "decimal", "string", "bytes", "timestamp"), "count": ("int", "float", "bool", "decimal", "string", "bytes", "timestamp")}
_TAKES["max"] = _TAKES["min"]


def aggregated(name: str, arg: Typed, identity_nulls: bool = False) -> tuple[Column, Kind]:
    """The Spark aggregate; with ``identity_nulls`` sum and count of nothing are zeros rather than null."""
    if arg.kind.name not in _TAKES[name]:
        raise StatementError(f"aggregate {name!r} doesn't take {arg.kind}")
    c, kind = arg.col, arg.kind
    if name == "count":
        return F.count(c), INT
    if name in ("min", "max"):
        if kind == FLOAT:  # NaN is neither
            c = F.when(~F.isnan(c), c)
        return (F.min if name == "min" else F.max)(c), kind
    if name == "sum":
        out = F.sum(c).cast(kind.spark)
        return (F.coalesce(out, F.lit(0).cast(kind.spark)) if identity_nulls else out), kind
    if kind == TIMESTAMP:
        return from_millis(F.avg(to_millis(c)).cast("bigint")), TIMESTAMP
    if kind.name == "decimal":
        return F.avg(c.cast("double")).cast("decimal(38,6)"), decimal()
    return F.avg(c), FLOAT


def _calls(items: list[A.Item], typed, text: str, identity_nulls: bool) -> list[Column]:
    out, names = [], set()
    for item in items:
        call = item.expr
        if not isinstance(call, A.Call) or call.name not in _TAKES or not call.args:
            raise StatementError("an aggregate is one of sum, count, min, max and avg", text, getattr(call, "at", None))
        name = item.alias or item.text
        if name in names:
            raise StatementError(f"two columns are named {name!r}", text, call.at)
        names.add(name)
        try:
            out.append(aggregated(call.name, typed.typed(call.args[0]), identity_nulls)[0].alias(name))
        except StatementError as e:
            raise StatementError(e.message, text, call.at) if e.at is None else e from None
    return out


def key_names(by: list[A.Item]) -> list[str]:
    return [i.alias or i.text for i in by]


def window_start(size: int, hop: int) -> int:
    """Offset of window starts for windows whose ends are multiples of the hop."""
    return (hop - size % hop) % hop


def aggregate(
    df: DataFrame, items: list[A.Item], by: list[A.Item], size: int | None = None, hop: int | None = None, lateness: int = 0, window_cols: bool = False,
    final_watermark: int | None = None, identity_nulls: bool = False, modules=None, text: str = "", hidden: str | None = None,
) -> DataFrame:
    """One row a group: event_time (the latest), window bounds if asked for, keys, aggregates.

    Windows end at multiples of ``hop``.  ``final_watermark`` (ms) leaves out windows that it hasn't closed, as a stream
    does that has come so far; without one every window that has a row is given.  ``hidden`` names a last column for the
    window's start.
    """
    typed = analyzer(df, modules, text)
    if (size is None) != (hop is None):
        raise StatementError("'size' and 'hop' go together", text)
    calls = _calls(items, typed, text, identity_nulls)
    keys = [typed.typed(i.expr).col.alias(n) for i, n in zip(by, key_names(by), strict=True)]
    timed = "event_time" in df.columns
    latest = [F.max("event_time").alias("event_time")] if timed else []
    if size is None:
        grouped = df.groupBy(*keys) if keys else df.groupBy()
        out = grouped.agg(*latest, *calls)
        return out.select(*(["event_time"] if timed else []), *[c for c in out.columns if c != "event_time"]).transform(lambda d: d)
    if hop > size:
        raise StatementError("'hop' can't be larger than 'size'", text)
    if not timed:
        raise StatementError("a windowed aggregate needs event_time", text)
    window = F.window("event_time", f"{size} milliseconds", f"{hop} milliseconds", f"{window_start(size, hop)} milliseconds").alias("__window")
    out = df.groupBy(window, *keys).agg(*latest, *calls)
    bounds = [F.col("__window.start").alias("ws"), F.col("__window.end").alias("we")]
    if final_watermark is not None:
        out = out.where(to_millis(F.col("__window.end")) - 1 + lateness <= final_watermark)
    rest = [F.col(f"`{c}`") for c in out.columns if c not in ("__window", "event_time")]
    return out.select("event_time", *(bounds if window_cols else []), *rest, *([bounds[0].alias(hidden)] if hidden else []))

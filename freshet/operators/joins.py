"""Joins of two streams within a span of event time, and of a stream with a table's current rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatementError
from ..types import kind_of, to_millis

#: A table side of at most so many rows is broadcast; above, or where it can't be counted, Spark decides.
BROADCAST_ROWS = 200_000


def _checked(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> None:
    for a, b in keys:
        for df, c in ((left, a), (right, b)):
            if c in ("offset", "event_time"):
                raise StatementError(f"{c!r} can't be a join key")
            if c not in df.columns:
                raise StatementError(f"unknown column {c!r} in a join; there are {', '.join(df.columns)}")
        if kind_of(left.schema[a].dataType) != kind_of(right.schema[b].dataType):
            raise StatementError(f"join keys {a!r} and {b!r} are of different types")


def _some_key(keys: list[str]):
    """Rows whose keys are all null take no part, on either side."""
    return functools.reduce(lambda x, y: x | y, [F.col(f"`{k}`").isNotNull() for k in keys])


def _sides(left, right, keys):
    left = left.where(_some_key([a for a, _ in keys])).drop("offset")
    right = right.where(_some_key([b for _, b in keys])).drop("offset")
    return left.select(*[F.col(f"`{c}`").alias(f"l_{c}") for c in left.columns]), right.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns])


def _equal(keys, null_safe: bool):
    pairs = [(F.col(f"`l_{a}`"), F.col(f"`r_{b}`")) for a, b in keys]
    return functools.reduce(lambda x, y: x & y, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])


def _equal_or_null(keys, left: DataFrame):
    """Null-safe equality out of plain ones, which is all that streaming joins take: is it null, and a value if not."""
    parts = []
    for a, b in keys:
        l, r = F.col(f"`l_{a}`"), F.col(f"`r_{b}`")  # noqa: E741
        kind = left.schema[f"l_{a}"].dataType
        none = F.timestamp_millis(F.lit(0)) if isinstance(kind, T.TimestampType) else F.lit(False) if isinstance(kind, T.BooleanType) else F.lit("0").cast(kind)
        parts += [l.isNull() == r.isNull(), F.coalesce(l, none) == F.coalesce(r, none)]
    return functools.reduce(lambda x, y: x & y, parts)


def watermarked(df: DataFrame, lateness: int, idle: int | None = None, other: DataFrame | None = None) -> DataFrame:
    """``df`` with its watermark; with ``idle`` (ms) it lags no more than that behind the event times of ``other``.

    The other side's times, less ``idle``, pass the watermark as beats and are left out after it, so a silent source doesn't
    hold up its neighbour.  This goes by event time: a replay gives what the first run gave.
    """
    if idle is not None and other is not None:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != "event_time"]
        beats = other.select((F.col("event_time") - F.expr(f"INTERVAL {idle} MILLISECOND")).alias("event_time"), *nulls, F.lit(True).alias("__beat"))
        df = df.withColumn("__beat", F.lit(False)).unionByName(beats)
    df = df.withWatermark("event_time", f"{lateness} milliseconds")
    if "__beat" in df.columns:
        # both name the event time, so that no filter on a key, and not this one, is moved below the watermark
        shown = [F.when(F.col("event_time").isNotNull(), F.col(f"`{c}`")).alias(c) if c != "event_time" else F.col(c) for c in df.columns if c != "__beat"]
        df = df.where(F.when(F.col("__beat"), F.lit(None)).otherwise(F.col("event_time")).isNotNull()).select(*shown)
    return df


def _output(joined: DataFrame, event_time, left_cols, right_cols) -> DataFrame:
    return joined.select(event_time.alias("event_time"), *[F.col(f"`{c}`") for c in left_cols], *[F.col(f"`{c}`") for c in right_cols])


def _by_time(l_side: DataFrame, r_side: DataFrame, within: int, how: str):
    """Both sides with a ``__slot`` of time that rows within reach of each other share.

    The side that an outer join pads has one slot a row, the other is repeated in each of the one or two that it reaches, so
    a pair still meets once.  A key with a long history is then compared slot by slot and not as a whole; of a streaming
    join the state is kept by slot too, and its watermark goes by the event times as before.
    """
    width = 4 * within + 4
    slot = lambda side, shift: F.floor((to_millis(F.col(f"{side}_event_time")) + shift) / F.lit(width))
    one = lambda df, side: df.withColumn("__slot", slot(side, 0))
    each = lambda df, side: df.withColumn("__slot", F.explode(F.sequence(slot(side, -within - 1), slot(side, within + 1))))
    return (one(l_side, "l"), each(r_side, "r")) if how != "right" else (each(l_side, "l"), one(r_side, "r"))


def stream_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], within: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose event times are ``within`` ms of each other, both ends included.

    A single key is never null here, so plain equality serves; with several, single nulls are equal to each other.
    Outer sides are settled: a row without a partner is padded once, when no partner can come any more.
    """
    _checked(left, right, keys)
    streaming = left.isStreaming or right.isStreaming
    l_side, r_side = _sides(left, right, keys)
    span = F.expr(f"INTERVAL {within} MILLISECOND")
    near = (F.col("r_event_time") >= F.col("l_event_time") - span) & (F.col("r_event_time") <= F.col("l_event_time") + span)
    same = _equal(keys, len(keys) > 1) if len(keys) == 1 or not streaming else _equal_or_null(keys, l_side)
    on, dropped = same & near, {f"r_{b}" for _, b in keys}
    l_slots, r_slots = _by_time(l_side, r_side, within, how)
    joined = l_slots.join(r_slots, on & (l_slots["__slot"] == r_slots["__slot"]), how)
    right_cols = [c for c in r_side.columns if c not in dropped]
    return _output(joined, F.greatest("l_event_time", "r_event_time"), l_side.columns, right_cols)


def table_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], table_side: str, how: str = "inner", table_keys: list[str] | None = None) -> DataFrame:
    """Each stream row with the table's row of the same key; event time is the stream's."""
    if how == table_side:
        raise StatementError("the outer side of a join can't be the table")
    _checked(left, right, keys)
    on_table = {(a if table_side == "left" else b) for a, b in keys}
    if table_keys is not None and on_table != set(table_keys):
        raise StatementError(f"a table is joined on its whole key ({', '.join(table_keys)})")
    l_side, r_side = _sides(left, right, keys)
    stream = "r" if table_side == "left" else "l"
    joined = l_side.join(r_side, _equal(keys, len(keys) > 1), how)
    dropped = {f"r_{b}" for _, b in keys} | {f"{stream}_event_time"}
    return _output(joined, F.col(f"{stream}_event_time"), [c for c in l_side.columns if c not in dropped], [c for c in r_side.columns if c not in dropped])


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if not table.isStreaming and table.limit(rows + 1).count() <= rows else table

"""Stored streams and tables as DataFrames: offsets, latest row by key, compaction, deletion, retention, lookups."""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import StatementError
from ..functions.scalar import Typed
from ..session import materialised
from ..types import kind_of, to_millis


def with_offset(df: DataFrame, partition: str | None = None, order: tuple[str, ...] = ("event_time",), first: int = 0) -> DataFrame:
    """Adds an ``offset``, gapless from ``first`` in each partition, where there is none; it is the first column.

    Without a partition column rows are numbered as they lie: the plan is materialised once, so that its partitions hold
    still, the rows of each are numbered by themselves and shifted by the count of those before.  Nothing is shuffled or
    sorted, and one number a partition comes to the driver.
    """
    if "offset" in df.columns:
        return df
    if partition is not None:
        numbered = df.withColumn("offset", F.row_number().over(Window.partitionBy(partition).orderBy(*order)).cast("long") - 1 + first)
        return numbered.select("offset", *df.columns)
    held = materialised(df)
    sizes = dict(held.groupBy(F.spark_partition_id().alias("part")).count().collect())
    before = list(itertools.accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=first))
    starts = F.lit(np.array(before, dtype=np.int64))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return held.select((F.get(starts, F.spark_partition_id()) + inside).alias("offset"), *df.columns)


def latest_by_key(df: DataFrame, keys: list[str], arrival: list[str | Column] | None = None) -> DataFrame:
    """The last row of each key (of all rows without one), as a table keeps it; null keys are equal.

    One aggregation with partial results before the shuffle: a hot key sends one row from each task.
    """
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise StatementError(f"unknown key column {missing[0]!r}")
    kept = [c for c in df.columns if c != "offset"]
    order = arrival or [c for c in ("event_time", "offset") if c in df.columns]
    if not arrival and "offset" not in order:  # rows of one time tell no order; the greatest one stays, whichever way they lie
        order += [c for c in kept if c not in order]
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in kept]), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("__row")
    grouped = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)]) if keys else df.groupBy()
    return grouped.agg(row).where("__row IS NOT NULL").select(*[F.col(f"__row.`{c}`").alias(c) for c in kept])


def compact(df: DataFrame, key: str = "key", partition: list[str] | None = None, offset: str = "offset") -> DataFrame:
    """The record of each key with the highest offset, and every record without a key.

    Keyed records are aggregated with partial results before the shuffle; those without a key aren't moved.
    """
    groups = [F.col(f"`{c}`").alias(f"__k{n}") for n, c in enumerate([*(partition or []), key])]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    last = df.where(F.col(key).isNotNull()).groupBy(*groups).agg(F.max_by(row, F.col(offset)).alias("__row"))
    return last.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns]).unionByName(df.where(F.col(key).isNull()))


def delete_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without rows whose key is in ``gone``."""
    renamed = gone.select(*[F.col(f"`{k}`").alias(f"__g{n}") for n, k in enumerate(keys)]).distinct()
    same = functools.reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__g{n}")) for n, k in enumerate(keys)])
    return table.join(renamed, same, "left_anti")


def retained(df: DataFrame, retention: int | None, now: Column | None = None, created: str = "event_time") -> DataFrame:
    """Rows younger than ``retention`` ms; 0 or None keeps all."""
    if not retention:
        return df
    return df.where(to_millis(F.col(created)) + retention > to_millis(now if now is not None else F.current_timestamp()))


def offsets_by_time(df: DataFrame, millis: int | None, partition: str = "partition", which: str = "at") -> DataFrame:
    """(partition, offset): the first at or after a time, or the "earliest", or the "latest" (one past the last)."""
    if which == "latest":
        return df.groupBy(partition).agg((F.max("offset") + 1).alias("offset"))
    rows = df if which == "earliest" else df.where(to_millis(F.col("event_time")) >= millis)
    return rows.groupBy(partition).agg(F.min("offset").alias("offset"))


# ---------------------------------------------------------------- lookups


def get(df: DataFrame, keys: list[str], values: list[Typed]) -> DataFrame:
    """Rows by a key or the first columns of one; a null value matches nulls."""
    _prefix(df, keys, values, "get")
    conditions = [F.col(f"`{k}`").eqNullSafe(v.col) for k, v in zip(keys, values, strict=False)]
    return df.where(functools.reduce(lambda a, b: a & b, conditions))


def scan_range(df: DataFrame, keys: list[str], low: list[Typed] | None, high: list[Typed] | None, low_incl: bool = True, high_incl: bool = False) -> DataFrame:
    """Rows whose key, as far as bounds are given, lies between them in key order; nulls are lowest.

    The first column's bound stands on its own as well, where Parquet's statistics can use it.
    """
    for bound, incl, way in ((low, low_incl, 1), (high, high_incl, -1)):
        if bound is None:
            continue
        _prefix(df, keys, bound, "scan")
        df = df.where(_beyond(list(zip(keys, bound, strict=False)), incl, way))
        first, column = bound[0], F.col(f"`{keys[0]}`")
        if first.const is not None:
            df = df.where(column >= first.col if way > 0 else column.isNull() | (column <= first.col))
    return df


def _prefix(df, keys, values, what):
    if not keys:
        raise StatementError(f"a {what} by key needs a table that has one")
    if len(values) > len(keys):
        raise StatementError(f"{len(values)} key values for a key of {len(keys)} columns ({', '.join(keys)})")
    for k, v in zip(keys, values, strict=False):
        if kind_of(df.schema[k].dataType) != v.kind:
            raise StatementError(f"key column {k!r} is of type {kind_of(df.schema[k].dataType)}, not {v.kind}")


def _beyond(pairs: list[tuple[str, Typed]], incl: bool, way: int) -> Column:
    """(k1, k2, ...) after the bound (``way`` 1) or before it, the bound itself included or not."""
    (name, value), *rest = pairs
    c, v = F.col(f"`{name}`"), value.col
    if way > 0:
        past = (v.isNull() & c.isNotNull()) | (c > v)
    else:
        past = (c.isNull() & v.isNotNull()) | (c < v)
    past = F.coalesce(past, F.lit(False))
    here = c.eqNullSafe(v)
    if rest:
        return past | (here & _beyond(rest, incl, way))
    return past | here if incl else past

"""Stateful processors for the two rules that Spark's own operators don't follow.

``eager_outer_join`` pads an outer row the moment it finds no partner, and still gives the match if one comes later.
``record_late_windows`` drops a late record even where one of its windows is still open.
Both keep state by key in the state store, over Arrow batches, and drop it by event time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..types import to_millis


def _plain(value, whole: bool):
    """A pandas value as Python's; whole numbers beside nulls have become floats."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value and whole):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return int(value) if whole else value.item() if hasattr(value, "item") else value


class _EagerJoin(StatefulProcessor):
    def __init__(self, within: int, outer: str, schema: T.StructType, left: list[str], right: list[str]):
        self.within, self.outer, self.schema, self.left, self.right = within, outer, schema, left, right

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        columns, whole = self.schema.names, [isinstance(f.dataType, T.LongType) for f in self.schema]
        out = []
        for batch in rows:
            for row in batch[columns].itertuples(index=False, name=None):
                row = tuple(map(_plain, row, whole))
                mine = dict(zip(columns, row, strict=True))
                side, at = mine["side__"], mine["ms__"]
                found = [h for h in held if h[columns.index("side__")] != side and abs(h[columns.index("ms__")] - at) <= self.within]
                for h in found:
                    other = dict(zip(columns, h, strict=True))
                    l, r = (mine, other) if side == "l" else (other, mine)  # noqa: E741
                    out.append({"et__": max(l["ms__"], r["ms__"])} | {c: l[c] for c in self.left} | {c: r[c] for c in self.right})
                if not found and side == self.outer:
                    out.append({"et__": at} | {c: mine[c] if side == "l" else None for c in self.left} | {c: mine[c] if side == "r" else None for c in self.right})
                held.append(row)
        mark = timerValues.getCurrentWatermarkInMs()
        kept = [h for h in held if h[columns.index("ms__")] + 2 * self.within >= mark]
        self.rows.put(kept) if kept else self.rows.clear()
        yield pd.DataFrame(out, columns=["et__", *self.left, *self.right])

    def close(self) -> None:
        pass


def eager_outer_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], within: int, how: str, lateness: int = 1000) -> DataFrame:
    """A streaming outer join that pads at once; output columns are those of ``operators.joins.stream_join``."""
    l_cols, r_cols = [c for c in left.columns if c != "offset"], [c for c in right.columns if c != "offset"]

    def side(df, mark, own, other, other_mark, other_df):
        return df.select(
            F.lit(mark).alias("side__"), to_millis(F.col("event_time")).alias("ms__"), F.col("event_time").alias("time__"),
            *[F.col(f"`{k[0 if mark == 'l' else 1]}`").alias(f"k{n}__") for n, k in enumerate(keys)],
            *[F.col(f"`{c}`").alias(f"{mark}_{c}") for c in own], *[F.lit(None).cast(other_df.schema[c].dataType).alias(f"{other_mark}_{c}") for c in other],
        )

    a, b = side(left, "l", l_cols, r_cols, "r", right), side(right, "r", r_cols, l_cols, "l", left)
    both = a.unionByName(b).withWatermark("time__", f"{lateness} milliseconds")
    some = " OR ".join(f"k{n}__ IS NOT NULL" for n in range(len(keys)))
    state = T.StructType([f for f in both.schema if f.name != "time__" and not re.fullmatch(r"k\d+__", f.name)])
    l_names, r_names = [f"l_{c}" for c in l_cols], [f"r_{c}" for c in r_cols if c not in {k for _, k in keys}]
    fields = {f.name: f for f in both.schema}
    output = T.StructType([T.StructField("et__", T.LongType()), *[fields[c] for c in (*l_names, *r_names)]])
    grouped = both.where(some).groupBy(*[f"k{n}__" for n in range(len(keys))])
    joined = grouped.transformWithStateInPandas(
        statefulProcessor=_EagerJoin(within, "l" if how == "left" else "r", state, l_names, r_names), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )
    return joined.select(F.timestamp_millis("et__").alias("event_time"), *l_names, *r_names)


def record_late_windows(df: DataFrame, lateness: int) -> DataFrame:
    """For static data with a known order of arrival (``batch``, a number): records that a stream would drop as late go.

    A record is late where its event time plus ``lateness`` is not after the watermark of the batches before; that watermark
    is a running maximum over batches, of which there are far fewer than records.
    """
    from pyspark.sql.window import Window

    tops = df.groupBy("batch").agg(F.max(to_millis(F.col("event_time"))).alias("__top"))
    marks = tops.withColumn("__mark", F.max("__top").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    kept = df.join(F.broadcast(marks), "batch").where(F.col("__mark").isNull() | (to_millis(F.col("event_time")) + lateness > F.col("__mark")))
    return kept.drop("__mark")

"""Encodings of results: JSON lines and Arrow."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import BYTES, TIMESTAMP, kind_of, to_millis


def json_lines(df: DataFrame, header: bool = False) -> DataFrame:
    """One JSON array a row: decimals and bytes as strings, time stamps as ms; with a header, names and types come first
    (as rows with ``n`` 0 and 1)."""
    parts = [F.coalesce(F.regexp_extract(F.to_json(F.struct(t.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")) for t in _values(df)]
    line = F.concat(F.lit("["), F.concat_ws(",", *[F.when(p == "", F.lit("null")).otherwise(p) for p in parts]), F.lit("]"))
    rows = df.select(F.lit(2).alias("n"), line.alias("line"))
    if not header:
        return rows
    names, types = json.dumps(df.columns), json.dumps([str(kind_of(f.dataType)) for f in df.schema])
    top = df.sparkSession.range(1).select(F.inline(F.array(F.struct(F.lit(0).alias("n"), F.lit(names).alias("line")), F.struct(F.lit(1), F.lit(types)))))
    return top.union(rows)


def _values(df: DataFrame) -> list:
    out = []
    for f in df.schema:
        kind, c = kind_of(f.dataType), F.col(f"`{f.name}`")
        out.append(c.cast("string") if kind.name == "decimal" or kind == BYTES else to_millis(c) if kind == TIMESTAMP else c)
    return out


def arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()

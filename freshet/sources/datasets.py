"""Data sets of script tests: blocks of CSV rows (key, headers, value, time) under a ``dataset:name,encoder,topic`` line."""

from __future__ import annotations

import csv
import datetime
import io

from pyspark.sql import DataFrame, SparkSession

from .topics import FILE_SCHEMA, headers_text


def read(text: str) -> dict[str, tuple[str, list[tuple]]]:
    """name -> (topic, rows); reading stops at the first blank line."""
    found: dict[str, tuple[str, list[tuple]]] = {}
    rows: list[tuple] = []
    for line in text.split("\n"):
        if not line.strip():
            break
        if line.startswith("dataset:"):
            name, _, topic = line[8:].split(",")
            rows = []
            found[name.strip()] = (topic.strip(), rows)
            continue
        key, headers, value, time = next(csv.reader(io.StringIO(line)))
        at = datetime.datetime.strptime(time.strip(), "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=datetime.UTC)
        rows.append((0, len(rows), at, key.encode(), headers_text(headers), value.encode() if value else None))
    return found


def topic(spark: SparkSession, text: str, names: list[str]) -> DataFrame:
    sets = read(text)
    rows = [(p, k, *rest) for k, (p, _, *rest) in enumerate(r for n in names for r in sets[n][1])]
    return spark.createDataFrame(rows, FILE_SCHEMA)

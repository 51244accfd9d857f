"""Small tables and shorthand for statements."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from freshet.engine import Engine

UTC = datetime.UTC


def ms(n):
    return datetime.datetime.fromtimestamp(n / 1000, UTC)


def evaluate(spark, expression, schema="x int", rows=((1,),), **settings):
    """Values of one expression over a small table."""
    engine = Engine(spark, **settings)
    df = spark.createDataFrame(list(rows), schema).coalesce(1)
    engine.register_table("t", df)
    out = engine.execute(f"(scan all from t) -> (project {expression} as v)").collect()
    values = [r["v"] for r in out]
    return values[0] if len(rows) == 1 else values


def rows_of(df, *columns):
    shown = [F.unix_millis(c).alias(c) if dict(df.dtypes).get(c) == "timestamp" else F.col(f"`{c}`") for c in (columns or df.columns)]
    return sorted((tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.select(*shown).collect()), key=repr)

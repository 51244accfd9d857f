"""The seven column types of the pipeline language and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import StatementError


@dataclass(frozen=True)
class Kind:
    name: str
    precision: int = 0
    scale: int = 0

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.name == "decimal" else self.name

    @property
    def spark(self) -> T.DataType:
        if self.name == "decimal":
            return T.DecimalType(self.precision, self.scale)
        return _SPARK[self.name]


INT, FLOAT, BOOL, STRING, BYTES, TIMESTAMP = map(Kind, ("int", "float", "bool", "string", "bytes", "timestamp"))
_SPARK = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(), "timestamp": T.TimestampType()}
_WIDENED = {T.ByteType: INT, T.ShortType: INT, T.IntegerType: INT, T.LongType: INT, T.FloatType: FLOAT, T.DoubleType: FLOAT, T.BooleanType: BOOL, T.StringType: STRING, T.BinaryType: BYTES, T.TimestampType: TIMESTAMP, T.TimestampNTZType: TIMESTAMP}


def decimal(precision: int = 38, scale: int = 6) -> Kind:
    if not (1 <= precision <= 38 and 0 <= scale <= precision):
        raise StatementError(f"decimal({precision},{scale}) needs a precision from 1 to 38 and a scale up to it")
    return Kind("decimal", precision, scale)


def kind_of(spark_type: T.DataType) -> Kind:
    if isinstance(spark_type, T.DecimalType):
        return decimal(spark_type.precision, spark_type.scale)
    found = _WIDENED.get(type(spark_type))
    if found is None:
        raise StatementError(f"columns of type {spark_type.simpleString()} have no place in a pipeline")
    return found


def parse_kind(text: str) -> Kind:
    text = text.replace(" ", "")
    if text.startswith("decimal("):
        return decimal(*map(int, text[8:-1].split(",")))
    if text in _SPARK:
        return Kind(text)
    raise StatementError(f"unknown type {text!r}")


def to_millis(col: Column) -> Column:
    return F.unix_millis(col)


def from_millis(col: Column) -> Column:
    return F.timestamp_millis(col)


def conform(df: DataFrame) -> DataFrame:
    """Widen integers and floats, and take time stamps as UTC to the millisecond; needs no shuffle and no copy."""
    out = []
    for f in df.schema:
        kind, c = kind_of(f.dataType), F.col(f"`{f.name}`")
        if kind == TIMESTAMP:
            c = F.date_trunc("millisecond", c.cast(T.TimestampType()))
        elif f.dataType != kind.spark:
            c = c.cast(kind.spark)
        out.append(c.alias(f.name))
    return df.select(*out)

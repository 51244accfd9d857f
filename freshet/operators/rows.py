"""Row-level operators: each takes and gives a DataFrame, static or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StatementError
from ..plans import ast as A
from ..plans.analyze import Analyzer, scope_of
from ..types import kind_of

SYSTEM = ("offset", "event_time")


def analyzer(df: DataFrame, modules=None, text: str = "", params=None) -> Analyzer:
    return Analyzer(scope_of(df.schema), modules, text, params)


def filter_rows(df: DataFrame, expr, modules=None, text: str = "", params=None) -> DataFrame:
    """Rows for which the expression is true; neither false nor null."""
    return df.where(analyzer(df, modules, text, params).truth(expr))


def project(df: DataFrame, items: list[A.Item], keep_system: bool, modules=None, text: str = "", params=None) -> DataFrame:
    """The expressions, named by alias, column or ``col<i>``; in streams the system columns come first."""
    typed = analyzer(df, modules, text, params)
    out, names = [], []
    if keep_system:
        names = [c for c in SYSTEM if c in df.columns]
        out = [F.col(c) for c in names]
    for k, item in enumerate(items):
        bare = item.expr.name if isinstance(item.expr, A.Name) else None
        if keep_system and bare in SYSTEM and item.alias is None:
            raise StatementError(f"{bare!r} is carried along and can't be projected; give it an alias", text, item.expr.at)
        name = item.alias or bare or f"col{k}"
        if name in names:
            raise StatementError(f"two columns are named {name!r}", text, getattr(item.expr, "at", None))
        names.append(name)
        out.append(typed.typed(item.expr).col.alias(name))
    return df.select(*out)


def partition(df: DataFrame, by: list[str], partitions: int | None, const: bool = False) -> DataFrame:
    """Rows dealt by key, without offsets.

    Grouping and joining deal rows by themselves, so this is only a physical hint; in a streaming query, whose state
    is dealt by its own keys, it would be one more shuffle and is left out.
    """
    missing = [c for c in by if c not in df.columns]
    if missing:
        raise StatementError(f"unknown column {missing[0]!r} in 'partition by'")
    df = df.drop("offset")
    if df.isStreaming or partitions is None:
        return df
    return df.repartition(1) if const else df.repartition(partitions, *[F.col(f"`{c}`") for c in by])


def union(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, by position; types have to be equal, names are those of the first."""
    plain = [df.drop("offset") for df in inputs]
    first = [kind_of(f.dataType) for f in plain[0].schema]
    for k, df in enumerate(plain[1:], 2):
        kinds = [kind_of(f.dataType) for f in df.schema]
        if kinds != first:
            raise StatementError(f"input {k} of the union has columns ({', '.join(map(str, kinds))}), the first ({', '.join(map(str, first))})")
    out = plain[0]
    for df in plain[1:]:
        out = out.union(df)
    return out


def sort(df: DataFrame, items: list[A.Item], modules=None, text: str = "", params=None) -> DataFrame:
    """Ordered rows; nulls come first when ascending and last when descending."""
    typed = analyzer(df, modules, text, params)
    cols = [typed.typed(i.expr).col for i in items]
    return df.orderBy(*[c.desc_nulls_last() if i.descending else c.asc_nulls_first() for c, i in zip(cols, items, strict=True)])

"""Syntax trees of expressions, operators and statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object
    kind: str
    at: int = -1


@dataclass(frozen=True)
class Name:
    name: str
    at: int = -1


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    at: int = -1


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object
    at: int = -1


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    at: int = -1


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    at: int = -1


@dataclass(frozen=True)
class Item:
    """An expression in a list, its alias, its direction in a sort, and its source text without blanks."""

    expr: object
    alias: str | None = None
    descending: bool = False
    text: str = ""


@dataclass(frozen=True)
class Operator:
    """One step: ``name`` as in "store stream"; ``args`` as the operator defines them."""

    name: str
    args: dict = field(default_factory=dict)
    at: int = -1


@dataclass(frozen=True)
class CreateStream:
    name: str
    operators: tuple[Operator, ...]
    text: str = ""


@dataclass(frozen=True)
class Delete:
    name: str


@dataclass(frozen=True)
class Prepare:
    name: str
    query: Query
    text: str = ""


@dataclass(frozen=True)
class DeleteQuery:
    name: str


@dataclass(frozen=True)
class ListStreams:
    pattern: str | None = None


@dataclass(frozen=True)
class Show:
    name: str


@dataclass(frozen=True)
class Query:
    operators: tuple[Operator, ...]
    text: str = ""

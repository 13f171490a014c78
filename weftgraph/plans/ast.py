"""Syntax tree of the query language: plain dataclasses, compared by value."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


# Expressions
@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    key: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Slice:
    of: Any
    start: Any
    end: Any


@dataclass(frozen=True)
class ListLit:
    items: tuple


@dataclass(frozen=True)
class MapLit:
    items: tuple  # ((key, expr), ...)


@dataclass(frozen=True)
class MapProjection:
    of: str
    every: bool
    items: tuple


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    value: Any


@dataclass(frozen=True)
class Quantifier:
    kind: str
    var: str
    source: Any
    where: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    start: Any
    var: str
    source: Any
    value: Any


@dataclass(frozen=True)
class HasLabels:
    of: Any
    labels: tuple


@dataclass(frozen=True)
class PatternExpr:
    """A pattern as a predicate, or with `value` as a comprehension, or with `count` as its number of matches."""

    pattern: Any
    where: Any = None
    value: Any = None


@dataclass(frozen=True)
class ShortestPath:
    pattern: Any


# Patterns
@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple
    props: Any


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple
    props: Any
    direction: str  # out, in, both
    low: int | None = None  # both None: a single step
    high: int | None = None
    variable: bool = False


@dataclass(frozen=True)
class Pattern:
    var: str | None
    parts: tuple  # node, rel, node, ...


# Clauses
@dataclass
class Match:
    patterns: list
    where: Any
    optional: bool = False
    hints: list = field(default_factory=list)


@dataclass
class Unwind:
    source: Any
    var: str


@dataclass
class Projection:
    items: list  # (expr, alias)
    star: bool
    distinct: bool
    order: list  # (expr, ascending)
    skip: Any
    limit: Any
    where: Any
    final: bool


@dataclass
class CallProc:
    name: str
    args: list
    yields: list | None
    where: Any


@dataclass
class SubQuery:
    query: Any
    recursive: Any = None  # initial items of a recursive one
    until: Any = None


@dataclass
class Create:
    patterns: list


@dataclass
class Merge:
    pattern: Any
    on_create: list
    on_match: list


@dataclass
class SetItems:
    items: list  # (kind, target, key, value, merge)


@dataclass
class Remove:
    items: list


@dataclass
class Delete:
    items: list
    detach: bool


@dataclass
class Foreach:
    var: str
    source: Any
    body: list


@dataclass
class LoadCsv:
    headers: bool
    url: Any
    var: str
    separator: str


@dataclass
class Query:
    """Clauses of each branch; `everything[i]`: whether the union with branch i keeps repeated rows."""

    branches: list
    everything: list
    explain: bool = False

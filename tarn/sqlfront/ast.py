"""Syntax trees of the dialect. Nodes are frozen and compare by value; lists are tuples."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


# Expressions


@dataclass(frozen=True)
class Lit(Node):
    """A literal; kind is number, string, bool or null, value its text."""

    kind: str
    value: str = ""


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star(Node):
    """``*``, or ``t.*`` with a qualifier."""

    of: str = ""


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    """op: OR AND = != <= >= < > + - * / % || LIKE, NOT LIKE, ILIKE."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class In(Node):
    """Membership in a list, an array or other expression, or a query."""

    arg: Node
    among: Node
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node
    negated: bool = False


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    other: Node | None = None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    to: Node


@dataclass(frozen=True)
class Interval(Node):
    value: Node
    unit: str


@dataclass(frozen=True)
class Extract(Node):
    part: str
    arg: Node


@dataclass(frozen=True)
class Tuple(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Array(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Index(Node):
    """a[i], counted from 1."""

    arg: Node
    at: Node


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Query(Node):
    """A query inside an expression; ``exists`` marks EXISTS (...)."""

    select: Select
    exists: bool = False


@dataclass(frozen=True)
class Order(Node):
    """nulls is FIRST, LAST or empty; fill holds (FROM, TO, STEP, STALENESS) or is absent."""

    expr: Node
    desc: bool = False
    nulls: str = ""
    collate: str = ""
    fill: tuple[Node | None, ...] | None = None


@dataclass(frozen=True)
class Window(Node):
    """frame: ROWS or RANGE with two bounds as (offset or None, direction)."""

    partition: tuple[Node, ...] = ()
    order: tuple[Order, ...] = ()
    frame: tuple[str, tuple, tuple] | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    params: tuple[Node, ...] | None = None
    over: Window | None = None
    distinct: bool = False


# Types


@dataclass(frozen=True)
class Type(Node):
    """A type by name; args are types, (name, type) fields, literals or enum pairs (label, number)."""

    name: str
    args: tuple[Any, ...] = ()


# Queries


@dataclass(frozen=True)
class Table(Node):
    parts: tuple[str, ...]
    alias: str = ""
    final: bool = False


@dataclass(frozen=True)
class SubSelect(Node):
    select: Select
    alias: str = ""


@dataclass(frozen=True)
class TableFunction(Node):
    name: str
    args: tuple[Node, ...]
    alias: str = ""


@dataclass(frozen=True)
class Join(Node):
    """kind: INNER LEFT RIGHT FULL CROSS; strictness: empty, GLOBAL, ASOF or ARRAY."""

    kind: str
    strictness: str
    table: Node
    on: Node | None = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Group(Node):
    """mode: empty, CUBE, ROLLUP or TOTALS."""

    exprs: tuple[Node, ...] = ()
    all: bool = False
    mode: str = ""


@dataclass(frozen=True)
class Select(Node):
    items: tuple[tuple[Node, str], ...]
    distinct: bool = False
    with_: tuple[tuple[str, Select], ...] = ()
    from_: Node | None = None
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: Group | None = None
    having: Node | None = None
    order: tuple[Order, ...] = ()
    interpolate: tuple[tuple[str, Node | None], ...] | None = None
    limit_by: tuple[int, int, tuple[Node, ...]] | None = None
    limit: int | None = None
    offset: int | None = None
    settings: tuple[tuple[str, Node], ...] = ()


# Statements


@dataclass(frozen=True)
class Column(Node):
    """kind: empty, DEFAULT, MATERIALIZED, EPHEMERAL or ALIAS, with its expression."""

    name: str
    type: Type | None
    kind: str = ""
    expr: Node | None = None
    codec: tuple[Node, ...] = ()
    ttl: Node | None = None
    comment: str | None = None


@dataclass(frozen=True)
class Stmt(Node):
    """A statement: its kind, such as CREATE TABLE, its object's name and the rest by clause."""

    kind: str
    name: tuple[str, ...] = ()
    clauses: tuple[tuple[str, Any], ...] = ()

    def get(self, clause: str, default: Any = None) -> Any:
        return dict(self.clauses).get(clause, default)

    def having(self, **more: Any) -> Stmt:
        kept = {k: v for k, v in self.clauses if k not in more} | {k: v for k, v in more.items() if v not in (None, False, ())}
        return replace(self, clauses=tuple(sorted(kept.items())))


def stmt(kind: str, name: tuple[str, ...] = (), **clauses: Any) -> Stmt:
    """A statement without its empty clauses, those that are left by name."""
    return Stmt(kind, name).having(**clauses)


def rebuilt(node: Any, change, skip: tuple[type, ...] = ()) -> Any:
    """The tree with ``change`` applied to every node from below; change returns a node or None to keep it. Nodes of ``skip`` stay."""
    if isinstance(node, tuple):
        return tuple(rebuilt(x, change, skip) for x in node)
    if not is_dataclass(node) or isinstance(node, skip):
        return node
    new = {f.name: rebuilt(getattr(node, f.name), change, skip) for f in fields(node)}
    node = type(node)(**new)
    changed = change(node)
    return node if changed is None else changed


def walk(node: Any, skip: tuple[type, ...] = ()):
    """All nodes of a tree, the root first, without those of ``skip`` and what is in them."""
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x, skip)
    elif is_dataclass(node) and not isinstance(node, skip):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name), skip)

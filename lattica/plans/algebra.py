"""The algebra that queries are parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """A constant in its canonical form."""

    text: str


Node = Var | Term


# Property paths.  A plain predicate is a Term or Var.
@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    first: object
    rest: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    """``path`` once or more (``least`` 1), any times (0), or at most once (``single``)."""

    path: object
    least: int
    single: bool = False


@dataclass(frozen=True)
class NotIn:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


# Expressions.
@dataclass(frozen=True)
class Call:
    """A function or operator over expressions."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool


# Graph patterns.
@dataclass(frozen=True)
class Triple:
    s: Node
    p: object
    o: Node


@dataclass
class Filter:
    expr: object


@dataclass
class Optional_:
    group: Group


@dataclass
class Union:
    groups: list[Group]


@dataclass
class Minus:
    group: Group


@dataclass
class Bind:
    expr: object
    var: Var


@dataclass
class Values:
    vars: list[Var]
    rows: list[tuple[str | None, ...]]


@dataclass
class SubSelect:
    query: Select


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Select:
    """A query of any form: ``form`` is select, ask, construct or describe."""

    form: str
    where: Group
    star: bool = False
    items: list[tuple[Var, object | None]] = field(default_factory=list)
    distinct: bool = False
    group_by: list[tuple[object, Var | None]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[Triple] = field(default_factory=list)
    targets: list[Node] = field(default_factory=list)

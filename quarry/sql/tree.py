"""The syntax tree. at is where a node begins: (line, column); it takes no part in comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field

At = tuple[int, int]


@dataclass(frozen=True)
class Node:
    at: At = field(compare=False, default=(1, 1), kw_only=True)


@dataclass(frozen=True)
class Literal(Node):
    value: object
    kind: str


@dataclass(frozen=True)
class Name(Node):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node


@dataclass(frozen=True)
class In(Node):
    arg: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class Like(Node):
    arg: Node
    pattern: Node


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    kind: str


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Sort(Node):
    arg: Node
    descending: bool
    nulls_first: bool


@dataclass(frozen=True)
class Frame(Node):
    """Offsets from the current row; None is unbounded."""

    start: int | None
    end: int | None


@dataclass(frozen=True)
class Over(Node):
    call: Call
    partition: tuple[Node, ...]
    order: tuple[Sort, ...]
    frame: Frame | None


@dataclass(frozen=True)
class Item(Node):
    value: Node
    alias: str | None


@dataclass(frozen=True)
class Table(Node):
    name: str
    namespace: str | None
    alias: str


@dataclass(frozen=True)
class Join(Node):
    table: Table
    how: str  # inner, left, right, full
    on: Node


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    table: Table
    joins: tuple[Join, ...]
    where: Node | None
    groups: tuple[Node, ...]
    sets: tuple[tuple[Node, ...], ...] | None
    having: Node | None
    order: tuple[Sort, ...]
    limit: int | None

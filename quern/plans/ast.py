"""The query tree.  Both front ends build it; ``compile`` turns it into columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    def __and__(self, other: Node) -> Node:
        return And((self, other))

    def __or__(self, other: Node) -> Node:
        return Or((self, other))

    def __invert__(self) -> Node:
        return Not(self)

    def boost(self, factor: float) -> Node:
        return Boost(self, factor)


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class MatchNone(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Phrase(Node):
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Wildcard(Node):
    pattern: str
    field: str | None = None


@dataclass(frozen=True)
class Range(Node):
    field: str
    lower: object = None
    upper: object = None
    include_lower: bool = True
    include_upper: bool = True


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class Terms(Node):
    """A keyword or number equal to one of the values."""

    field: str
    values: tuple


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    part: Node


@dataclass(frozen=True)
class Boost(Node):
    part: Node
    factor: float


class QueryError(ValueError):
    """The query cannot be run: bad syntax or an unknown field."""

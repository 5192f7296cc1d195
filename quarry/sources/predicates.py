"""Scan predicates as data: comparisons, membership, null tests, and, or, not."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import EngineError, ErrorCode
from quarry.operators.relational import quoted


@dataclass(frozen=True)
class Compare:
    """op: eq ne lt le gt ge in not_in is_null is_not_null. value: a literal, or a tuple for in and not_in."""

    column: str
    op: str
    value: object = None

    def columns(self) -> Iterator[str]:
        yield self.column

    def col(self) -> Column:
        c = F.col(quoted(self.column))
        match self.op:
            case "eq":
                return c == self.value
            case "ne":
                return c != self.value
            case "lt":
                return c < self.value
            case "le":
                return c <= self.value
            case "gt":
                return c > self.value
            case "ge":
                return c >= self.value
            case "in":
                return c.isin(*self.value)
            case "not_in":
                return ~c.isin(*self.value)
            case "is_null":
                return c.isNull()
            case "is_not_null":
                return c.isNotNull()
        raise EngineError(ErrorCode.INVALID_REQUEST, f"Unknown scan operator {self.op!r}.")


@dataclass(frozen=True)
class Combined:
    """op: and, or; or not, of one part."""

    op: str
    parts: tuple

    def columns(self) -> Iterator[str]:
        for p in self.parts:
            yield from p.columns()

    def col(self) -> Column:
        cols = [p.col() for p in self.parts]
        if self.op == "not":
            return ~cols[0]
        out = cols[0]
        for c in cols[1:]:
            out = out & c if self.op == "and" else out | c
        return out

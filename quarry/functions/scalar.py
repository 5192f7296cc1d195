"""Scalar semantics where the dialect differs from Spark's defaults. Everything stays in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import EngineError, ErrorCode
from quarry.sql.types import DECIMAL, NUMERIC, common, spark_type


@dataclass(frozen=True)
class Typed:
    """A column with its kind."""

    kind: str
    nullable: bool
    col: Column

    def to(self, kind: str) -> Typed:
        return self if kind == self.kind else Typed(kind, self.nullable, cast(self.col, self.kind, kind))


def wrong(message: str, at: tuple[int, int], **context) -> EngineError:
    return EngineError(ErrorCode.BINDING_ERROR, message, line=at[0], column=at[1], **context)


def literal(value: object, kind: str, at: tuple[int, int]) -> Typed:
    if kind == "int":
        if not -(1 << 63) <= value < 1 << 63:
            raise wrong("Integer literal out of range.", at)
        kind = "int32" if -(1 << 31) <= value < 1 << 31 else "int64"
    return Typed(kind, value is None, F.lit(value).cast(spark_type(kind)) if kind != "null" else F.lit(None))


def cast(c: Column, old: str, new: str) -> Column:
    """CAST: booleans print as True and False, anything nonzero or nonempty is true, timestamps truncate to dates."""
    if old == new:
        return c
    if old == "boolean" and new == "string":
        return F.when(c, "True").when(~c, "False")
    if new == "boolean" and old in NUMERIC:
        return c != 0
    if new == "boolean" and old in ("string", "binary"):
        return F.length(c) > 0
    if new == "boolean" and old in ("date", "timestamp"):
        return F.when(c.isNotNull(), True)
    if new == "decimal" and old == "boolean":
        return c.cast("int").cast(DECIMAL)
    return c.cast(spark_type(new))


def arithmetic(op: str, a: Typed, b: Typed, at: tuple[int, int]) -> Typed:
    for x in (a, b):
        if x.kind not in (*NUMERIC, "null"):
            raise wrong(f"Operator {op} needs numbers, not {x.kind}.", at)
    kind = common(a.kind, b.kind, at)
    nullable = a.nullable or b.nullable
    if kind == "null":
        return Typed("null", True, F.lit(None))
    if kind == "decimal":
        # Operands keep their own precision, which leaves Spark digits for the result.
        x, y = (v.col.cast("decimal(20,0)") if v.kind in ("int32", "int64") else v.col.cast("decimal(28,9)") if v.kind in ("float32", "float64") else v.col for v in (a, b))
    else:
        if op == "/" and kind in ("int32", "int64"):
            kind = "float64"
        x, y = a.to(kind).col, b.to(kind).col
    if op == "%" and kind != "decimal":
        r = x % y
        out = F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)
    else:
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[op]()
    return Typed(kind, nullable, out.cast(spark_type(kind)))


def compare(op: str, a: Typed, b: Typed, at: tuple[int, int]) -> Typed:
    kind = comparable(common(a.kind, b.kind, at), at)
    x, y = a.to(kind).col, b.to(kind).col
    out = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
    return Typed("boolean", a.nullable or b.nullable, out)


def comparable(kind: str, at: tuple[int, int]) -> str:
    if kind in ("list", "struct"):
        raise wrong(f"Values of type {kind} cannot be compared.", at)
    return kind


def like(a: Typed, pattern: Typed) -> Column:
    """% and _ only: there is no escape character, so one that text does not hold stands in for Spark's."""
    return F.like(a.to("string").col, pattern.to("string").col, F.lit("\x01"))


def substring(s: Column, start: Column, length: Column | None) -> Column:
    """1-based; starts before 1 count as 1."""
    begin = F.when(start.isNotNull(), F.greatest(start, F.lit(1)).cast("int"))
    return F.substring(s, begin, F.lit(2**31 - 1) if length is None else length.cast("int"))


def round_double(x: Column, digits: int) -> Column:
    """To so many digits, ties of the exact binary value to even.

    x 10^d is formed with its rounding error (a two-product), so that a value just under or over
    a decimal tie is told from a real one.
    """
    scale = F.lit(float(10 ** abs(digits)))
    if digits < 0:
        p = x / scale
        e = _two_product_error(F.floor(p).cast("double"), scale, F.floor(p).cast("double") * scale) * 0
    else:
        p = x * scale
        e = _two_product_error(x, scale, p)
    low = F.floor(p).cast("double")
    over = (p - low - 0.5) + e
    even = F.pmod(low, F.lit(2.0)) == 0
    n = F.when(over > 0, low + 1).when(over < 0, low).otherwise(F.when(even, low).otherwise(low + 1))
    rounded = n * scale if digits < 0 else n / scale
    return F.when(F.isnan(x) | (F.abs(p) >= float(1 << 52)), x).otherwise(rounded)


def _two_product_error(a: Column, b: Column, p: Column) -> Column:
    def split(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    (ah, al), (bh, bl) = split(a), split(b)
    return ((ah * bh - p) + ah * bl + al * bh) + al * bl


def rounded(x: Typed, digits: int) -> Column:
    if x.kind in ("float32", "float64"):
        return round_double(x.col.cast("double"), digits).cast(spark_type(x.kind))
    if x.kind == "decimal" or digits < 0:
        return F.bround(x.col.cast(DECIMAL if x.kind == "decimal" else "decimal(20,0)"), digits).cast(spark_type(x.kind))
    return x.col


#: Names, and how many arguments.
SCALARS = {"LOWER": (1, 1), "UPPER": (1, 1), "LENGTH": (1, 1), "ABS": (1, 1), "COALESCE": (1, None), "CONCAT": (1, None), "SUBSTRING": (2, 3), "ROUND": (1, 2)}
SYNONYMS = {"SUBSTR": "SUBSTRING", "LEN": "LENGTH", "CHAR_LENGTH": "LENGTH", "IFNULL": "COALESCE", "LCASE": "LOWER", "UCASE": "UPPER", "MEAN": "AVG"}


def call(name: str, args: list[Typed], literals: list[object], at: tuple[int, int]) -> Typed:
    """A scalar function of bound arguments. literals: their values where they are literals."""
    least, most = SCALARS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise wrong(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} argument{'s' * (most != 1)}.", at, function=name)

    def want(i: int, kinds: tuple[str, ...], what: str) -> Typed:
        if args[i].kind not in (*kinds, "null"):
            raise wrong(f"{name} needs {what}, not {args[i].kind}.", at, function=name)
        return args[i]

    nullable = any(a.nullable for a in args)
    if name == "COALESCE":
        kind = args[0].kind
        for a in args[1:]:
            kind = common(kind, a.kind, at)
        return Typed(kind, all(a.nullable for a in args), F.coalesce(*[a.to(kind).col for a in args]))
    if name == "CONCAT":
        return Typed("string", nullable, F.concat(*[want(i, ("string",), "strings").to("string").col for i in range(len(args))]))
    if name in ("LOWER", "UPPER", "LENGTH"):
        s = want(0, ("string",), "a string").to("string").col
        return Typed("int64", nullable, F.char_length(s).cast("bigint")) if name == "LENGTH" else Typed("string", nullable, F.lower(s) if name == "LOWER" else F.upper(s))
    if name == "SUBSTRING":
        s = want(0, ("string",), "a string").to("string").col
        numbers = [want(i, ("int32", "int64"), "integers").to("int64").col for i in range(1, len(args))]
        if len(args) == 3 and isinstance(literals[2], int) and literals[2] < 0:
            raise wrong("SUBSTRING needs a length of at least 0.", at, function=name)
        return Typed("string", nullable, substring(s, numbers[0], numbers[1] if len(numbers) > 1 else None))
    x = want(0, NUMERIC, "a number")
    if x.kind == "null":
        x = x.to("float64")
    if name == "ABS":
        return Typed(x.kind, nullable, F.abs(x.col))
    digits = 0
    if len(args) == 2:
        want(1, ("int32", "int64"), "an integer")
        if not isinstance(literals[1], int):
            raise wrong("ROUND needs an integer literal for its digits.", at, function=name)
        digits = literals[1]
    return Typed(x.kind, nullable, rounded(x, max(-18, min(18, digits))))

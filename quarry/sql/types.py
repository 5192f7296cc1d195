"""Kinds of values, how they combine, and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from quarry.errors import EngineError, ErrorCode

#: By precedence: of two kinds the later is their common one.
NUMERIC = ("int32", "int64", "float32", "float64", "decimal")
KINDS = ("null", "boolean", *NUMERIC, "string", "binary", "date", "timestamp", "list", "struct")
DECIMAL = T.DecimalType(38, 9)
_SPARK = {
    "null": T.NullType(), "boolean": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "decimal": DECIMAL,
    "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
}


def spark_type(kind: str) -> T.DataType:
    return _SPARK[kind]


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType)):
        return "int32"
    for kind, s in _SPARK.items():
        if type(s) is type(dt):
            return kind
    if isinstance(dt, (T.CharType, T.VarcharType)):
        return "string"
    return {T.TimestampType: "timestamp", T.ArrayType: "list", T.StructType: "struct"}.get(type(dt), "struct")


def common(a: str, b: str, at: tuple[int, int]) -> str:
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a in NUMERIC and b in NUMERIC:
        return max(a, b, key=NUMERIC.index)
    if {a, b} == {"date", "timestamp"}:
        return "timestamp"
    raise EngineError(ErrorCode.BINDING_ERROR, f"Types {a} and {b} have no common type.", line=at[0], column=at[1])


def schema_of(fields: list[dict]) -> T.StructType:
    """A declared schema: fields with name, data_type, nullable, metadata and children."""
    return T.StructType([T.StructField(f["name"], _declared(f), f.get("nullable", True), f.get("metadata") or {}) for f in fields])


def _declared(f: dict) -> T.DataType:
    kind, meta, children = f["data_type"], f.get("metadata") or {}, f.get("children") or []
    if kind == "decimal":
        return T.DecimalType(int(meta.get("precision", 38)), int(meta.get("scale", 9)))
    if kind == "timestamp" and (meta.get("timezone") or meta.get("tz")):
        return T.TimestampType()
    if kind == "list":
        return T.ArrayType(_declared(children[0]), children[0].get("nullable", True))
    if kind == "struct":
        return schema_of(children)
    if kind not in _SPARK:
        raise EngineError(ErrorCode.INVALID_REQUEST, f"Unknown data type {kind!r}.", column=f["name"])
    return _SPARK[kind]


def fields_of(schema: T.StructType) -> list[dict]:
    """schema_of's inverse."""
    return [_described(f.name, f.dataType, f.nullable) for f in schema.fields]


def _described(name: str, dt: T.DataType, nullable: bool) -> dict:
    out = {"name": name, "data_type": kind_of(dt), "nullable": nullable, "metadata": {}, "children": []}
    if isinstance(dt, T.DecimalType):
        out["metadata"] = {"precision": dt.precision, "scale": dt.scale}
    elif isinstance(dt, T.TimestampType):
        out["metadata"] = {"timezone": "UTC"}
    elif isinstance(dt, T.ArrayType):
        out["children"] = [_described("element", dt.elementType, dt.containsNull)]
    elif isinstance(dt, T.StructType):
        out["children"] = fields_of(dt)
    return out

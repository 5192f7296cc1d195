"""Readers by format, with projection and predicate; the registry of formats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.errors import EngineError, ErrorCode, from_spark
from quarry.operators.relational import quoted
from quarry.sources import avro, iceberg, store
from quarry.sources.predicates import Combined, Compare
from quarry.sources.tasks import FileScanTask

Reader = Callable[[SparkSession, str | list[str], StructType | None, dict], DataFrame]


def _csv(spark: SparkSession, path: str | list[str], schema: StructType | None, properties: dict) -> DataFrame:
    """With a header; an empty field is NULL, also for strings. Declared types are forced, others inferred."""
    r = spark.read.option("header", True).option("sep", properties.get("delimiter", ",")).option("mode", "FAILFAST").option("enforceSchema", False)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def _spark(fmt: str) -> Reader:
    def read(spark: SparkSession, path: str | list[str], schema: StructType | None, properties: dict) -> DataFrame:
        r = spark.read.schema(schema) if schema else spark.read
        return r.format(fmt).load(path)

    return read


#: Format name to reader; register() adds to it.
READERS: dict[str, Reader] = {
    "csv": _csv,
    "parquet": _spark("parquet"),
    "orc": _spark("orc"),
    "avro": lambda spark, path, schema, _: avro.read(spark, path, schema),
    "iceberg": lambda spark, path, schema, properties: iceberg.read(spark, path if isinstance(path, str) else path[0], properties, properties.get("scan_predicate")),
}


SPLITTABLE = ("csv", "parquet", "orc", "avro")


def register(fmt: str, reader: Reader) -> None:
    READERS[fmt] = reader


@dataclass(frozen=True)
class ScanRequest:
    projection: Sequence[str] | None = None
    predicate: Compare | Combined | None = None
    files: Sequence[str] | None = None


def read(spark: SparkSession, fmt: str, location: str | list[str], schema: StructType | None = None, properties: dict | None = None) -> DataFrame:
    if fmt not in READERS:
        raise EngineError(ErrorCode.INVALID_REQUEST, f"Unknown format {fmt!r}.", format=fmt)
    location = store.resolved(spark, location) if isinstance(location, str) else [store.resolved(spark, x) for x in location]
    try:
        return READERS[fmt](spark, location, schema, properties or {})
    except Exception as e:
        raise from_spark(e) from e


def scan(spark: SparkSession, fmt: str, location: str, schema: StructType | None = None, request: ScanRequest = ScanRequest(), properties: dict | None = None) -> DataFrame:  # noqa: B008
    """The request's columns and rows. Spark pushes both into the readers that can use them."""
    known = (properties or {}) | ({"scan_predicate": request.predicate} if request.predicate else {})
    df = read(spark, fmt, list(request.files) if request.files else location, schema, known)
    used = [*(request.projection or ()), *(request.predicate.columns() if request.predicate else ())]
    missing = [c for c in used if c not in df.columns]
    if missing:
        raise EngineError(ErrorCode.INVALID_REQUEST, f"Unknown columns in the scan request: {missing}.", column_names=missing)
    if request.predicate:
        df = df.where(request.predicate.col())
    return df.select(*[quoted(c) for c in request.projection]) if request.projection else df


def tasks(spark: SparkSession, fmt: str, location: str, request: ScanRequest = ScanRequest(), properties: dict | None = None, max_bytes: int = 128 << 20) -> list[FileScanTask]:  # noqa: B008
    """The files a scan reads, those of splittable formats in ranges of at most max_bytes, in order of their paths."""
    location = store.resolved(spark, location)
    if fmt == "iceberg":
        return sorted(iceberg.tasks(spark, location, properties, request.predicate), key=lambda t: t.path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(request.files) if request.files else location)
    out = []
    for r in found.select("path", "length").orderBy("path").collect():  # names only: a row a file
        if r["path"].rsplit("/", 1)[1].startswith(("_", ".")):
            continue
        values = dict(part.split("=", 1) for part in r["path"].split("/")[:-1] if "=" in part)
        step = max_bytes if fmt in SPLITTABLE else max(1, r["length"])
        out += [FileScanTask(r["path"], fmt, at, min(step, r["length"] - at), None, values) for at in range(0, max(1, r["length"]), step)]
    return out

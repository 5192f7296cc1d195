"""Iceberg tables without a jar: the current snapshot's manifests name Parquet files for Spark to read.

Columns are matched by field id, so renamed ones keep their values and re-added ones do not inherit any.
Manifests are decoded on executors; files whose partition or column bounds exclude a scan's predicate
are never opened.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import EngineError, ErrorCode
from quarry.operators.relational import quoted
from quarry.sources.avro import records
from quarry.sources.predicates import Combined, Compare
from quarry.sources.tasks import FileScanTask


def _bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").head()
    if row is None:
        raise EngineError(ErrorCode.NOT_FOUND, f"Iceberg file {path} does not exist.")
    return bytes(row["content"])


def _metadata_path(spark: SparkSession, location: str) -> str:
    """The newest metadata file of a table folder, or the location itself if it is one."""
    if location.endswith(".json"):
        return location
    folder = f"{location.rstrip('/')}/metadata"
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.metadata.json").load(folder).select("path").collect()]
    number = lambda p: int(re.match(r"v?(\d+)", p.rsplit("/", 1)[1])[1])
    if not files:
        raise EngineError(ErrorCode.NOT_FOUND, f"No Iceberg metadata under {location}.")
    return max(files, key=number)


_PRIMITIVE = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType()}


def _type(t) -> T.DataType:
    if isinstance(t, str):
        if m := re.match(r"decimal\((\d+),\s*(\d+)\)", t):
            return T.DecimalType(int(m[1]), int(m[2]))
        return _PRIMITIVE.get(t, T.BinaryType())
    if t["type"] == "struct":
        return T.StructType([T.StructField(f["name"], _type(f["type"]), not f["required"], {"parquet.field.id": f["id"]}) for f in t["fields"]])
    if t["type"] == "list":
        return T.ArrayType(_type(t["element"]), not t["element-required"])
    return T.MapType(_type(t["key"]), _type(t["value"]), not t["value-required"])


@dataclass
class DataFile:
    path: str
    content: int  # 0 data, 1 position deletes, 2 equality deletes
    sequence: int
    rows: int | None
    size: int | None
    partition: dict
    equality_ids: list[int]
    lower: dict[int, bytes] = field(default_factory=dict)
    upper: dict[int, bytes] = field(default_factory=dict)
    nulls: dict[int, int] = field(default_factory=dict)


def _pairs(found) -> dict:
    """Avro has maps with number keys as lists of key and value."""
    return {x["key"]: x["value"] for x in found or ()} if isinstance(found, list) else dict(found or {})


_ENTRY = "path string, format string, content int, sequence long, rows long, size long, partition string, equality_ids array<int>, lower map<int,binary>, upper map<int,binary>, nulls map<int,bigint>"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0):
            rows = []
            for e in records(data.as_py()):
                f = e["data_file"]
                if e["status"] != 2:
                    rows.append(
                        {
                            "path": f["file_path"], "format": str(f["file_format"]).upper(), "content": f.get("content") or 0, "sequence": e.get("sequence_number"), "rows": f.get("record_count"), "size": f.get("file_size_in_bytes"),
                            "partition": json.dumps(f.get("partition") or {}, default=str), "equality_ids": f.get("equality_ids") or [],
                            "lower": list(_pairs(f.get("lower_bounds")).items()), "upper": list(_pairs(f.get("upper_bounds")).items()), "nulls": list(_pairs(f.get("null_value_counts")).items()),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [("path", pa.string()), ("format", pa.string()), ("content", pa.int32()), ("sequence", pa.int64()), ("rows", pa.int64()), ("size", pa.int64()), ("partition", pa.string()), ("equality_ids", pa.list_(pa.int32()))]
    + [(n, pa.map_(pa.int32(), t)) for n, t in (("lower", pa.binary()), ("upper", pa.binary()), ("nulls", pa.int64()))]
)


def _value(kind: str, raw: bytes):
    """A bound as its column's type has it, text as its bytes; None if the type is not compared here."""
    if kind in ("int", "long"):
        return int.from_bytes(raw, "little", signed=True)
    if kind in ("float", "double"):
        return struct.unpack("<f" if len(raw) == 4 else "<d", raw)[0]
    return raw if kind == "string" else None


def _may_match(p: Compare | Combined, f: DataFile, fields: dict[str, dict]) -> bool:
    """False only if no row of the file can satisfy the predicate."""
    if isinstance(p, Combined):
        found = [_may_match(x, f, fields) for x in p.parts] if p.op in ("and", "or") else [True]
        return all(found) if p.op == "and" else any(found)
    column = fields.get(p.column)
    if column is None or not isinstance(column["type"], str):
        return True
    i, kind = column["id"], column["type"]
    nulls = f.nulls.get(i)
    if p.op == "is_null":
        return nulls != 0
    if nulls is not None and nulls == f.rows:
        return False  # every other comparison is unknown of nulls
    if i not in f.lower or i not in f.upper:
        return True
    low, high = _value(kind, f.lower[i]), _value(kind, f.upper[i])

    def within(op: str, value) -> bool:
        value = value.encode() if isinstance(value, str) else value
        alike = isinstance(value, bytes) if kind == "string" else isinstance(value, (int, float)) and not isinstance(value, bool)
        if low is None or not alike or low != low or high != high or value != value:
            return True
        return {"eq": low <= value <= high, "lt": low < value, "le": low <= value, "gt": high > value, "ge": high >= value}.get(op, True)

    return any(within("eq", v) for v in p.value if v is not None) if p.op == "in" else within(p.op, p.value)


@dataclass
class Planned:
    schema: T.StructType
    fields: list[dict]
    data: list[DataFile]
    deletes: list[DataFile]
    files: int  # of data, before pruning
    renamed: bool  # whether a name has stood for different fields, or a field had different names


def plan(spark: SparkSession, location: str, properties: dict | None = None, predicate: Compare | Combined | None = None) -> Planned:
    """The current snapshot's files that a predicate leaves. Manifests are read by one Spark job."""
    meta = json.loads(_bytes(spark, (properties or {}).get("metadata_location") or _metadata_path(spark, location)))
    schemas = {s["schema-id"]: s for s in meta.get("schemas", [])}
    declared = schemas.get(meta.get("current-schema-id"), meta.get("schema"))
    schema = _type({"type": "struct", "fields": declared["fields"]})
    known = {(f["id"], f["name"]) for s in [declared, *schemas.values()] for f in s["fields"]}
    renamed = len({i for i, _ in known}) < len(known) or len({n for _, n in known}) < len(known)
    out = Planned(schema, declared["fields"], [], [], 0, renamed)
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == meta.get("current-snapshot-id")), None)
    if snapshot is None:
        return out
    listed = records(_bytes(spark, snapshot["manifest-list"])) if "manifest-list" in snapshot else [{"manifest_path": m} for m in snapshot["manifests"]]
    sequences = {m["manifest_path"]: m.get("sequence_number") or 0 for m in listed}
    if not sequences:
        return out
    by_name = {f["name"]: f for f in declared["fields"]}
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    manifests = spark.createDataFrame([(re.sub("^file:/+", "/", p), n) for p, n in sequences.items()], "manifest string, inherited long")
    found = spark.read.format("binaryFile").load(list(sequences)).select("content", name(F.col("path")).alias("manifest")).join(manifests, "manifest")
    for inherited in sorted(set(sequences.values())):
        for r in found.where(F.col("inherited") == inherited).select("content").mapInArrow(_entries, _ENTRY).collect():  # a row a file
            if r["format"] != "PARQUET":
                raise EngineError(ErrorCode.INVALID_REQUEST, f"Iceberg data files of format {r['format']} are not supported.")
            f = DataFile(
                r["path"], r["content"], inherited if r["sequence"] is None else r["sequence"], r["rows"], r["size"], json.loads(r["partition"]), list(r["equality_ids"]),
                {k: bytes(v) for k, v in r["lower"].items()}, {k: bytes(v) for k, v in r["upper"].items()}, dict(r["nulls"]),
            )
            if f.content:
                out.deletes.append(f)
            else:
                out.files += 1
                if predicate is None or _may_match(predicate, f, by_name):
                    out.data.append(f)
    return out


def tasks(spark: SparkSession, location: str, properties: dict | None = None, predicate: Compare | Combined | None = None) -> list[FileScanTask]:
    p = plan(spark, location, properties, predicate)
    gone = [(d.sequence, d.content, d.path) for d in p.deletes]
    applies = lambda f, sequence, content: sequence > f.sequence or content == 1 and sequence == f.sequence
    return [FileScanTask(f.path, "parquet", 0, f.size, f.rows, f.partition, tuple(path for n, c, path in gone if applies(f, n, c))) for f in p.data]


def _has_ids(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet file names field ids; files that other writers left and a table adopted have none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
    try:
        columns = reader.getFooter().getFileMetaData().getSchema().getFields()
        return any(columns.get(i).getId() is not None for i in range(columns.size()))
    finally:
        reader.close()


def _plain(t: T.DataType) -> T.DataType:
    """Without field ids: by name."""
    return T.StructType([T.StructField(f.name, _plain(f.dataType), f.nullable) for f in t.fields]) if isinstance(t, T.StructType) else t


def _by_id(spark: SparkSession, schema: T.StructType, paths: list[str], renamed: bool) -> DataFrame:
    """The files' rows, columns matched by field id if the first file has any, else by name. A column that
    a file lacks may share its name with another one there; names of the file's own keep pushed filters
    working, so others are asked for only if fields were renamed."""
    if not _has_ids(spark, paths[0]):
        return spark.read.schema(_plain(schema)).parquet(*paths)
    if not renamed:
        return spark.read.schema(schema).parquet(*paths)
    asked = [T.StructField(f"quarry_{f.metadata['parquet.field.id']}", f.dataType, f.nullable, f.metadata) for f in schema.fields]
    return spark.read.schema(T.StructType(asked)).parquet(*paths).withColumnsRenamed({a.name: f.name for a, f in zip(asked, schema.fields)})


def read(spark: SparkSession, location: str, properties: dict | None = None, predicate: Compare | Combined | None = None) -> DataFrame:
    """The current snapshot's rows; names are case-sensitive. Position and equality deletes apply.

    Columns are matched by field id; if the table's first file has none, by name. Filters and
    projections on the result reach the Parquet readers; predicate only keeps files from being read,
    its rows are still the caller's to filter.
    """
    p = plan(spark, location, properties, predicate)
    names = p.schema.fieldNames()
    if not p.data:
        return spark.createDataFrame([], _plain(p.schema))
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    df = _by_id(spark, p.schema, [f.path for f in p.data], p.renamed)
    if not p.deletes:
        return df
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    df = df.select(*[quoted(n) for n in names], name(F.col("_metadata.file_path")).alias("quarry_file"), F.col("_metadata.row_index").alias("quarry_pos"))
    places = [f.path for f in p.deletes if f.content == 1]
    if places:
        gone = spark.read.schema("file_path string, pos long").parquet(*places).select(name(F.col("file_path")).alias("quarry_file"), F.col("pos").alias("quarry_pos"))
        df = df.join(gone, ["quarry_file", "quarry_pos"], "left_anti")
    equal = [f for f in p.deletes if f.content == 2]
    if equal:
        short = lambda path: re.sub("^file:/+", "/", path)
        known = spark.createDataFrame([(short(f.path), f.sequence) for f in p.data], "quarry_file string, quarry_sequence long")
        df = df.join(known, "quarry_file")
        for ids in sorted({tuple(sorted(f.equality_ids)) for f in equal}):
            mine = [f for f in equal if tuple(sorted(f.equality_ids)) == ids]
            fields = [p.schema.fields[next(k for k, f in enumerate(p.fields) if f["id"] == i)] for i in ids]
            by_file = spark.createDataFrame([(short(f.path), f.sequence) for f in mine], "quarry_deletes string, quarry_from long")
            gone = _by_id(spark, T.StructType(fields), [f.path for f in mine], p.renamed)
            gone = gone.select(*[F.col(quoted(f.name)).alias(f"quarry_eq{k}") for k, f in enumerate(fields)], name(F.col("_metadata.file_path")).alias("quarry_deletes")).join(by_file, "quarry_deletes")
            on = F.col("quarry_sequence") < F.col("quarry_from")
            for k, f in enumerate(fields):
                on &= F.col(quoted(f.name)).eqNullSafe(F.col(f"quarry_eq{k}"))
            df = df.join(gone, on, "left_anti")
    return df.select(*[quoted(n) for n in names])

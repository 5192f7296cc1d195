"""Imports: source files into partitions of a table, with statistics, published by a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType

from quarry.catalog import Catalog
from quarry.errors import EngineError, ErrorCode, from_spark
from quarry.operators.relational import quoted
from quarry.sources import files
from quarry.sql.types import schema_of

WRITABLE = ("csv", "parquet", "orc")


def statistics(df: DataFrame, exact: Collection[str] = ()) -> dict:
    """Rows, and for each column nulls, distinct values, least, greatest and mean bytes, in one pass.
    Distinct values are sketched; those of columns in exact are counted, at the cost of a shuffle
    of all their values."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        plain = isinstance(f.dataType, AtomicType)
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if plain:
            aggs.append((F.count_distinct(c) if f.name in exact else F.approx_count_distinct(c, 0.02)).alias(f"d{i}"))
            if not isinstance(f.dataType, BinaryType):
                aggs += [F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
            aggs.append(F.avg(F.octet_length(c.cast("string"))).alias(f"b{i}"))
    r = df.agg(*aggs).first().asDict()
    cols = {f.name: {"null_count": r[f"n{i}"], "distinct_count": r.get(f"d{i}"), "min_value": r.get(f"l{i}"), "max_value": r.get(f"h{i}"), "average_size_bytes": r.get(f"b{i}")} for i, f in enumerate(df.schema.fields)}
    return {"row_count": r["rows"], "size_bytes": None, "columns": cols}


class Importer:
    """New files appear under data/<import id>; the manifest is replaced last, so readers see whole imports."""

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog

    def import_table(self, namespace: str, table: str, source: str, source_format: str | None = None, partitions: int = 1, key: str | None = None, exact: Collection[str] = ()) -> dict:
        """key: partitions by its hash; without, evenly. Names and their order must match the table's."""
        doc = self.catalog.table(namespace, table)
        fmt = source_format or doc["format"]
        for f in (fmt, doc["format"]):
            if f not in WRITABLE:
                raise EngineError(ErrorCode.INVALID_REQUEST, f"Format {f!r} cannot be imported.", format=f)
        if partitions < 1 or key is not None and key not in [f["name"] for f in doc["fields"]]:
            raise EngineError(ErrorCode.INVALID_REQUEST, "Imports need at least one partition and a key of the schema.", column_name=key)
        schema = schema_of(doc["fields"])
        df = files.read(self.spark, fmt, source)
        if df.columns != schema.fieldNames():
            raise EngineError(ErrorCode.INVALID_REQUEST, "The source's columns differ from the table's.", column_names=df.columns)
        df = df.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
        strategy = "hash" if key else "round_robin" if partitions > 1 else "single"
        import_id = uuid.uuid4().hex
        base = doc["location"].rstrip("/")
        target = f"{base}/data/{import_id}"
        fs, path = self._fs(base)
        try:
            if key:
                part = F.pmod(F.xxhash64(F.to_json(F.struct(F.col(quoted(key)).alias("k")))), F.lit(partitions)).cast("int")
                out = df.withColumn("quarry_part", part).repartition(partitions, "quarry_part")
            else:
                out = df.repartition(partitions) if partitions > 1 else df.coalesce(1)
                out = out.withColumn("quarry_part", F.spark_partition_id())
            out.write.option("header", True).partitionBy("quarry_part").format(doc["format"]).save(target)
            written = self._read(doc["format"], target, schema)
            stats = statistics(written, exact)
            counts = self.spark.read.format(doc["format"]).options(header=True, basePath=target).load(target).groupBy("quarry_part").count().collect()
            rows = {int(r["quarry_part"]): r["count"] for r in counts}
            parts = []
            for k in range(partitions):
                where = f"{target}/quarry_part={k}"
                size = fs.getContentSummary(path(where)).getLength() if k in rows else 0
                parts.append({"ordinal": k, "location": where, "strategy": strategy, "keys": [key] if key else [], "size_bytes": size, "row_count": rows.get(k, 0)})
            stats["size_bytes"] = sum(p["size_bytes"] for p in parts)
            manifest = {"version": 1, "import_id": import_id, "data": target, "fields": doc["fields"], "partitions": parts, "statistics": stats}
            self._publish(fs, path, f"{base}/_manifest.json", json.dumps(manifest, default=str))
        except Exception as e:
            fs.delete(path(target), True)
            raise from_spark(e) from e
        new = self.catalog.update_table(namespace, table, strategy=strategy, keys=[key] if key else [], partitions=parts, statistics=stats, properties=doc["properties"] | {"data": target})
        return {"table": new, "manifest_location": f"{base}/_manifest.json"}

    def _read(self, fmt: str, location: str, schema) -> DataFrame:
        return files.read(self.spark, fmt, location, schema).select(*[F.col(quoted(c)) for c in schema.fieldNames()])

    def _fs(self, location: str):
        jvm = self.spark._jvm
        make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return make(location).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def _publish(self, fs, path, target: str, text: str) -> None:
        """A temporary file takes the manifest's place by a rename."""
        tmp = path(f"{target}.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path(target)):
            fs.delete(path(target), False)
        if not fs.rename(tmp, path(target)):
            raise EngineError(ErrorCode.INTERNAL_ERROR, "The manifest could not be published.")

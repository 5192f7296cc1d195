"""The engine: tables by name, SELECT in, DataFrames out."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from quarry import diagnostics
from quarry.catalog import Catalog
from quarry.errors import EngineError
from quarry.importer import Importer
from quarry.plans.binder import Binder, Plan
from quarry.sources import files
from quarry.sql.types import schema_of

#: Cost-based optimisation uses statistics where tables have them; ANSI raises on overflow and zero divisors.
SETTINGS = {
    "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.session.timeZone": "UTC",
}


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, default_namespace: str = "default"):
        self.spark, self.catalog, self.default_namespace = spark, catalog, default_namespace
        self._frames: dict[str, DataFrame] = {}
        self._lock = threading.Lock()
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)

    def register(self, name: str, df: DataFrame) -> Engine:
        """A DataFrame, streaming ones included, under a name (or namespace.name)."""
        with self._lock:
            self._frames[name.lower()] = df
        return self

    def register_folder(self, folder: str, names: list[str], fmt: str = "parquet") -> Engine:
        for n in names:
            self.register(n, files.read(self.spark, fmt, f"{folder}/{n}.{fmt}"))
        return self

    def lookup(self, namespace: str | None, name: str) -> DataFrame | None:
        for full in (f"{namespace}.{name}",) if namespace else (name, f"{self.default_namespace}.{name}"):
            if full.lower() in self._frames:
                return self._frames[full.lower()]
        if self.catalog is None:
            return None
        try:
            doc = self.catalog.table(namespace or self.default_namespace, name)
        except EngineError:
            return None
        schema = schema_of(doc["fields"])
        df = files.read(self.spark, doc["format"], doc["properties"].get("data", doc["location"]), schema, doc["properties"])
        return df.select(*schema.fieldNames())

    def plan(self, sql: str) -> Plan:
        return Binder(self.lookup, self.default_namespace).bind(sql)

    def sql(self, sql: str) -> DataFrame:
        return self.plan(sql).dataframe()

    def explain(self, sql: str) -> dict:
        plan = self.plan(sql)
        return {"logical": plan.as_dict(), **diagnostics.plans(plan.dataframe()), "text": plan.pretty()}

    def importer(self) -> Importer:
        return Importer(self.spark, self.catalog)

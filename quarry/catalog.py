"""Namespaces and tables with their schemas, partitions and statistics, kept in one SQLite file."""

from __future__ import annotations

import datetime
import json
import re
import sqlite3
import threading
from contextlib import closing

from pyspark.sql.types import StructType

from quarry.errors import EngineError, ErrorCode
from quarry.sql.types import fields_of, schema_of

FORMATS = ("csv", "parquet", "avro", "orc", "iceberg")
STRATEGIES = ("single", "round_robin", "hash", "broadcast", "unknown")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _checked(name: str) -> str:
    if not _NAME.match(name) or len(name) > 255:
        raise EngineError(ErrorCode.INVALID_REQUEST, f"Invalid name {name!r}.")
    return name


class Catalog:
    """path: a file, or :memory:. Every change is one transaction."""

    def __init__(self, path: str = ":memory:"):
        self._db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self._lock = threading.RLock()
        with self._lock, closing(self._db.cursor()) as c:
            c.execute("PRAGMA foreign_keys = ON")
            c.execute("CREATE TABLE IF NOT EXISTS namespaces (name TEXT PRIMARY KEY, doc TEXT NOT NULL)")
            c.execute("CREATE TABLE IF NOT EXISTS tables (namespace TEXT NOT NULL REFERENCES namespaces(name) ON DELETE RESTRICT, name TEXT NOT NULL, doc TEXT NOT NULL, PRIMARY KEY (namespace, name))")

    def _run(self, sql: str, *args) -> list[tuple]:
        with self._lock, closing(self._db.cursor()) as c:
            return c.execute(sql, args).fetchall()

    # namespaces

    def create_namespace(self, name: str, properties: dict | None = None) -> dict:
        doc = {"name": _checked(name), "properties": properties or {}, "created_at": _now(), "updated_at": _now()}
        try:
            self._run("INSERT INTO namespaces VALUES (?, ?)", name, json.dumps(doc))
        except sqlite3.IntegrityError:
            raise EngineError(ErrorCode.CONFLICT, f"Namespace {name!r} exists.", namespace=name) from None
        return doc

    def namespaces(self) -> list[dict]:
        return [json.loads(d) for (d,) in self._run("SELECT doc FROM namespaces ORDER BY name")]

    def namespace(self, name: str) -> dict:
        found = self._run("SELECT doc FROM namespaces WHERE name = ?", name)
        if not found:
            raise EngineError(ErrorCode.NOT_FOUND, f"Namespace {name!r} does not exist.", namespace=name)
        return json.loads(found[0][0])

    def update_namespace(self, name: str, properties: dict) -> dict:
        doc = self.namespace(name) | {"properties": properties, "updated_at": _now()}
        self._run("UPDATE namespaces SET doc = ? WHERE name = ?", json.dumps(doc), name)
        return doc

    def delete_namespace(self, name: str) -> None:
        self.namespace(name)
        try:
            self._run("DELETE FROM namespaces WHERE name = ?", name)
        except sqlite3.IntegrityError:
            raise EngineError(ErrorCode.CONFLICT, f"Namespace {name!r} has tables.", namespace=name) from None

    # tables

    def create_table(self, namespace: str, name: str, schema: StructType | list[dict], fmt: str, location: str, strategy: str = "unknown", keys: list[str] | None = None, properties: dict | None = None) -> dict:
        self.namespace(namespace)
        doc = {"namespace": namespace, "name": _checked(name), "created_at": _now(), "partitions": [], "statistics": None}
        doc |= self._declared(schema, fmt, location, strategy, keys or [], properties or {})
        try:
            self._run("INSERT INTO tables VALUES (?, ?, ?)", namespace, name, json.dumps(doc))
        except sqlite3.IntegrityError:
            raise EngineError(ErrorCode.CONFLICT, f"Table {name!r} exists.", table=name) from None
        return doc

    def _declared(self, schema, fmt: str, location: str, strategy: str, keys: list[str], properties: dict) -> dict:
        fields = fields_of(schema) if isinstance(schema, StructType) else list(schema)
        schema_of(fields)
        names = [f["name"] for f in fields]
        if len(set(names)) < len(names) or not names:
            raise EngineError(ErrorCode.INVALID_REQUEST, "A schema needs fields of different names.", column_names=names)
        if fmt not in FORMATS or strategy not in STRATEGIES or not location:
            raise EngineError(ErrorCode.INVALID_REQUEST, "Unknown format or partition strategy, or no location.", format=fmt)
        if missing := sorted(set(keys) - set(names)):
            raise EngineError(ErrorCode.INVALID_REQUEST, f"Partition keys are not in the schema: {missing}.", column_names=missing)
        return {"fields": fields, "format": fmt, "location": location, "partition_strategy": strategy, "partition_keys": keys, "properties": properties, "updated_at": _now()}

    def tables(self, namespace: str) -> list[dict]:
        self.namespace(namespace)
        return [json.loads(d) for (d,) in self._run("SELECT doc FROM tables WHERE namespace = ? ORDER BY name", namespace)]

    def table(self, namespace: str, name: str) -> dict:
        found = self._run("SELECT doc FROM tables WHERE namespace = ? AND lower(name) = lower(?)", namespace, name)
        if not found:
            raise EngineError(ErrorCode.NOT_FOUND, f"Table {namespace}.{name} does not exist.", namespace=namespace, table=name)
        return json.loads(found[0][0])

    def update_table(self, namespace: str, name: str, **changes) -> dict:
        """Of schema, fmt, location, strategy, keys, properties; and partitions, statistics."""
        doc = self.table(namespace, name)
        now = {"schema": doc["fields"], "fmt": doc["format"], "location": doc["location"], "strategy": doc["partition_strategy"], "keys": doc["partition_keys"], "properties": doc["properties"]}
        doc |= self._declared(**now | {k: v for k, v in changes.items() if k in now})
        doc |= {k: changes[k] for k in ("partitions", "statistics") if k in changes}
        self._run("UPDATE tables SET doc = ? WHERE namespace = ? AND name = ?", json.dumps(doc), namespace, doc["name"])
        return doc

    def delete_table(self, namespace: str, name: str) -> None:
        doc = self.table(namespace, name)
        self._run("DELETE FROM tables WHERE namespace = ? AND name = ?", namespace, doc["name"])

    def close(self) -> None:
        self._db.close()


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()

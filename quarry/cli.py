"""Command line of the service; `serve` starts one in this process."""

from __future__ import annotations

import argparse
import json
import sys
import time
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from quarry.settings import Settings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("--url", default=Settings.of().url)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run SQL and print its rows")
    q.add_argument("sql")
    q.add_argument("--no-wait", action="store_true")
    q.add_argument("--page-size", type=int, default=100)
    q.add_argument("--poll-interval", type=float, default=0.1)
    sub.add_parser("explain", help="print the plans").add_argument("sql")
    for name in ("status", "cancel"):
        sub.add_parser(name).add_argument("query_id")
    cat = sub.add_parser("catalog", help="namespaces and tables").add_subparsers(dest="action", required=True)
    cat.add_parser("namespaces")
    for name in ("tables", "create-namespace", "delete-namespace"):
        cat.add_parser(name).add_argument("namespace")
    for name in ("create-table", "delete-table"):
        t = cat.add_parser(name)
        t.add_argument("namespace")
        t.add_argument("name")
        if name == "create-table":
            t.add_argument("--format", required=True, choices=["csv", "parquet", "avro", "orc", "iceberg"])
            t.add_argument("--location", required=True)
            t.add_argument("--schema", required=True, help='the columns as JSON: {"fields": [...]} with a name, a data_type and, if nulls are refused, nullable: false for each')
    i = sub.add_parser("import", help="load files into a table")
    i.add_argument("namespace")
    i.add_argument("table")
    i.add_argument("source")
    i.add_argument("--source-format", choices=["csv", "parquet", "orc"])
    i.add_argument("--partitions", type=int, default=1)
    i.add_argument("--key")
    s = sub.add_parser("serve", help="start the service on this machine's Spark")
    s.add_argument("--port", type=int, default=Settings.of().port)
    s.add_argument("--catalog", default=Settings.of().catalog)
    return p


class Client:
    def __init__(self, url: str):
        self.url = url.rstrip("/")

    def call(self, method: str, path: str, body: dict | None = None):
        data = None if body is None else json.dumps(body).encode()
        req = Request(f"{self.url}/api/v1{path}", data, {"Content-Type": "application/json"}, method=method)
        with urlopen(req) as r:
            raw = r.read()
        return json.loads(raw) if raw else None

    def query(self, sql: str, page: int, poll: float):
        q = self.call("POST", "/queries", {"sql": sql})
        while q["state"] in ("queued", "planning", "running"):
            time.sleep(poll)
            q = self.call("GET", f"/queries/{q['query_id']}")
        if q["state"] != "succeeded":
            return q
        rows, out = [], {"total": 1, "columns": []}
        while len(rows) < out["total"]:
            out = self.call("GET", f"/queries/{q['query_id']}/results?offset={len(rows)}&limit={page}")
            rows += out["rows"]
        return {"columns": [c["name"] for c in out["columns"]], "rows": rows}


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "serve":
        return _serve(a.port, a.catalog)
    c = Client(a.url)
    calls = {
        "explain": lambda: c.call("POST", "/queries/explain", {"sql": a.sql}),
        "status": lambda: c.call("GET", f"/queries/{a.query_id}"),
        "cancel": lambda: c.call("DELETE", f"/queries/{a.query_id}"),
        "query": lambda: c.call("POST", "/queries", {"sql": a.sql}) if a.no_wait else c.query(a.sql, a.page_size, a.poll_interval),
        "import": lambda: c.call("POST", f"/namespaces/{a.namespace}/tables/{a.table}/imports", {"source_location": a.source, "source_format": a.source_format, "partition_count": a.partitions, "partition_key": a.key}),
        "namespaces": lambda: c.call("GET", "/namespaces"),
        "tables": lambda: c.call("GET", f"/namespaces/{a.namespace}/tables"),
        "create-namespace": lambda: c.call("POST", "/namespaces", {"name": a.namespace}),
        "delete-namespace": lambda: c.call("DELETE", f"/namespaces/{a.namespace}"),
        "create-table": lambda: c.call("POST", f"/namespaces/{a.namespace}/tables", {"name": a.name, "format": a.format, "location": a.location, "schema": json.loads(a.schema)}),
        "delete-table": lambda: c.call("DELETE", f"/namespaces/{a.namespace}/tables/{a.name}"),
    }
    try:
        out = calls[a.action if a.command == "catalog" else a.command]()
    except HTTPError as e:
        print(e.read().decode(), file=sys.stderr)
        return 1
    if out is not None:
        print(json.dumps(out, indent=2, ensure_ascii=False))
    return 1 if isinstance(out, dict) and out.get("state") == "failed" else 0


def _serve(port: int, catalog: str) -> int:
    from pyspark.sql import SparkSession

    from quarry.catalog import Catalog
    from quarry.engine import Engine
    from quarry.http_api import server
    from quarry.service import QueryService

    known = Settings.of()
    builder = SparkSession.builder.appName("quarry")
    spark = (builder.master(known.master) if known.master else builder).getOrCreate()
    service = QueryService(Engine(spark, Catalog(catalog)), known.workers, known.most_rows, known.held_rows, known.keep_seconds)
    with server(service, port=port) as s:
        print(f"listening on {s.server_address[1]}", flush=True)
        s.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())

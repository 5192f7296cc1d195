"""The service over HTTP: queries under /api/v1/queries, the catalog under /api/v1/namespaces."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from quarry.errors import EngineError, ErrorCode, from_spark
from quarry.service import QueryService

_ID = "([A-Za-z0-9_]+)"


def routes(service: QueryService) -> list[tuple[str, re.Pattern, int, Callable]]:
    """method, path, status, handler of (match groups, query, body)."""
    c = service.engine.catalog
    table = lambda g, q, b: c.create_table(g[0], b["name"], b["schema"]["fields"], b["format"], b["location"], b.get("partition_strategy", "unknown"), b.get("partition_keys"), b.get("properties"))
    load = lambda g, q, b: service.engine.importer().import_table(g[0], g[1], b["source_location"], b.get("source_format"), b.get("partition_count", 1), b.get("partition_key"))
    found = [
        ("POST", "/queries", 202, lambda g, q, b: service.submit(b["sql"])),
        ("POST", "/queries/explain", 200, lambda g, q, b: service.explain(b["sql"])),
        ("GET", "/queries", 200, lambda g, q, b: {"queries": service.list()}),
        ("GET", f"/queries/{_ID}", 200, lambda g, q, b: service.get(g[0])),
        ("DELETE", f"/queries/{_ID}", 200, lambda g, q, b: service.cancel(g[0])),
        ("GET", f"/queries/{_ID}/results", 200, lambda g, q, b: service.results(g[0], int(q.get("offset", 0)), int(q.get("limit", 100)))),
        ("GET", f"/queries/{_ID}/plan", 200, lambda g, q, b: service.plan(g[0])),
        ("GET", f"/queries/{_ID}/metrics", 200, lambda g, q, b: service.metrics(g[0])),
        ("GET", f"/queries/{_ID}/advisor", 200, lambda g, q, b: service.advice(g[0])),
        ("GET", "/nodes", 200, lambda g, q, b: {"nodes": service.nodes()}),
        ("GET", "/namespaces", 200, lambda g, q, b: {"namespaces": c.namespaces()}),
        ("POST", "/namespaces", 201, lambda g, q, b: c.create_namespace(b["name"], b.get("properties"))),
        ("GET", f"/namespaces/{_ID}", 200, lambda g, q, b: c.namespace(g[0])),
        ("PATCH", f"/namespaces/{_ID}", 200, lambda g, q, b: c.update_namespace(g[0], b["properties"])),
        ("DELETE", f"/namespaces/{_ID}", 204, lambda g, q, b: c.delete_namespace(g[0])),
        ("GET", f"/namespaces/{_ID}/tables", 200, lambda g, q, b: {"tables": c.tables(g[0])}),
        ("POST", f"/namespaces/{_ID}/tables", 201, table),
        ("GET", f"/namespaces/{_ID}/tables/{_ID}", 200, lambda g, q, b: c.table(*g)),
        ("PATCH", f"/namespaces/{_ID}/tables/{_ID}", 200, lambda g, q, b: c.update_table(*g, **b)),
        ("DELETE", f"/namespaces/{_ID}/tables/{_ID}", 204, lambda g, q, b: c.delete_table(*g)),
        ("POST", f"/namespaces/{_ID}/tables/{_ID}/imports", 201, load),
    ]
    return [(m, re.compile(f"/api/v1{p}/?"), s, f) for m, p, s, f in found]


def server(service: QueryService, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Not yet started; port 0 takes a free one."""
    table = routes(service)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def answer(self, status: int, doc) -> None:
            data = b"" if status == 204 else json.dumps(doc, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_any(self) -> None:
            url = urlsplit(self.path)
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                body = json.loads(raw) if raw else {}
                for method, path, status, run in table:
                    if method == self.command and (m := path.fullmatch(url.path)):
                        return self.answer(status, run(m.groups(), {k: v[0] for k, v in parse_qs(url.query).items()}, body))
                raise EngineError(ErrorCode.NOT_FOUND, f"No such resource: {url.path}")
            except (KeyError, ValueError, TypeError) as e:
                e = EngineError(ErrorCode.INVALID_REQUEST, f"Invalid request: {e}")
                self.answer(e.status, e.as_dict())
            except Exception as e:
                e = from_spark(e)
                self.answer(e.status, e.as_dict())

        do_GET = do_POST = do_DELETE = do_PATCH = handle_any

    return ThreadingHTTPServer((host, port), Handler)

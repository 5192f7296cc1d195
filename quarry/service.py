"""Queries as jobs: submit, status, cancel, results by page, plan, metrics, advice."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import StrEnum

from quarry import advisor, diagnostics
from quarry.engine import Engine
from quarry.errors import EngineError, ErrorCode, from_spark


class State(StrEnum):
    QUEUED = "queued"
    PLANNING = "planning"
    RUNNING = "running"
    SUCCEEDED = "succeeded"
    FAILED = "failed"
    CANCELED = "canceled"


LOG = logging.getLogger("quarry.query")
FINAL = (State.SUCCEEDED, State.FAILED, State.CANCELED)


@dataclass
class Query:
    query_id: str
    sql: str
    state: State = State.QUEUED
    error: dict | None = None
    columns: list[dict] = field(default_factory=list)
    rows: list[list] | None = field(default_factory=list)  # None once they have expired
    plan: dict | None = None
    diagnostics: diagnostics.Diagnostics | None = None
    timeline: list[dict] = field(default_factory=list)
    done: threading.Event = field(default_factory=threading.Event)

    def as_dict(self) -> dict:
        return {"query_id": self.query_id, "sql": self.sql, "state": str(self.state), "error": self.error, "timeline": list(self.timeline)}


class QueryService:
    """most_rows bounds what the driver holds of one result; write larger ones with Engine.sql(...).write.

    Results expire after keep_seconds, and the oldest as soon as all together have over held_rows rows;
    what is known of their queries stays.
    """

    def __init__(self, engine: Engine, workers: int = 4, most_rows: int = 1_000_000, held_rows: int = 5_000_000, keep_seconds: float = 3600.0):
        self.engine, self.most_rows, self.held_rows, self.keep_seconds = engine, most_rows, held_rows, keep_seconds
        self._queries: dict[str, Query] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="query")

    def submit(self, sql: str) -> dict:
        q = Query(uuid.uuid4().hex, sql)
        self._to(q, State.QUEUED)
        with self._lock:
            self._queries[q.query_id] = q
        out = q.as_dict()
        self._pool.submit(self._run, q)
        return out

    def _to(self, q: Query, state: State) -> bool:
        with self._lock:
            if q.state in FINAL:
                return False
            q.state = state
            q.timeline.append({"state": str(state), "at": time.time()})
        level = logging.ERROR if state == State.FAILED else logging.INFO
        LOG.log(level, json.dumps({"query_id": q.query_id, "state": str(state), "at": q.timeline[-1]["at"], "error": q.error}, sort_keys=True))
        if state in FINAL:
            q.done.set()
        return True

    def _run(self, q: Query) -> None:
        sc = self.engine.spark.sparkContext
        try:
            if not self._to(q, State.PLANNING):
                return
            plan = self.engine.plan(q.sql)
            df = plan.dataframe()
            q.plan = {"logical": plan.as_dict(), **diagnostics.plans(df), "text": plan.pretty()}
            q.columns = [{"name": n, "data_type": k, "nullable": x} for n, k, x in plan.output]
            if not self._to(q, State.RUNNING):
                return
            sc.addJobTag(q.query_id)
            sc.setInterruptOnCancel(True)
            began = time.time()
            bounded = df.limit(self.most_rows + 1)
            rows = bounded.collect()
            if len(rows) > self.most_rows:
                raise EngineError(ErrorCode.RESOURCE_EXHAUSTED, f"The result has more than {self.most_rows} rows.", query_id=q.query_id)
            q.rows = [list(r) for r in rows]
            q.diagnostics = diagnostics.collect(bounded, time.time() - began)
            q.diagnostics.timeline = q.timeline
            q.diagnostics.stages = diagnostics.stages_of(sc, q.query_id)
            self._to(q, State.SUCCEEDED)
            self._expire()
        except Exception as e:
            q.error = from_spark(e).as_dict()["error"]
            self._to(q, State.FAILED)
        finally:
            sc.clearJobTags()

    def _expire(self) -> None:
        with self._lock:
            ended = sorted((q for q in self._queries.values() if q.state == State.SUCCEEDED and q.rows), key=lambda q: q.timeline[-1]["at"])
            held = sum(len(q.rows) for q in ended)
            for q in ended[:-1] if ended else []:
                if held > self.held_rows or time.time() - q.timeline[-1]["at"] > self.keep_seconds:
                    held -= len(q.rows)
                    q.rows = None
            if ended and time.time() - ended[-1].timeline[-1]["at"] > self.keep_seconds:
                ended[-1].rows = None

    def explain(self, sql: str) -> dict:
        return self.engine.explain(sql)

    def list(self) -> list[dict]:
        with self._lock:
            return [q.as_dict() for q in self._queries.values()]

    def _get(self, query_id: str) -> Query:
        if query_id not in self._queries:
            raise EngineError(ErrorCode.NOT_FOUND, f"Query {query_id} does not exist.", query_id=query_id)
        return self._queries[query_id]

    def get(self, query_id: str) -> dict:
        return self._get(query_id).as_dict()

    def wait(self, query_id: str, timeout: float | None = None) -> dict:
        q = self._get(query_id)
        q.done.wait(timeout)
        return q.as_dict()

    def cancel(self, query_id: str) -> dict:
        """Ended queries stay as they are."""
        q = self._get(query_id)
        if self._to(q, State.CANCELED):
            self.engine.spark.sparkContext.cancelJobsWithTag(query_id)
        return q.as_dict()

    def results(self, query_id: str, offset: int = 0, limit: int = 100) -> dict:
        q = self._get(query_id)
        if offset < 0 or not 1 <= limit <= 1000:
            raise EngineError(ErrorCode.INVALID_REQUEST, "offset is at least 0, limit from 1 to 1000.")
        self._succeeded(q)
        self._expire()
        rows = q.rows
        if rows is None:
            raise EngineError(ErrorCode.NOT_FOUND, f"The rows of query {query_id} have expired; run it again.", query_id=query_id)
        return {"query_id": query_id, "columns": q.columns, "rows": rows[offset : offset + limit], "offset": offset, "limit": limit, "total": len(rows)}

    def _succeeded(self, q: Query) -> None:
        if q.state != State.SUCCEEDED:
            raise EngineError(ErrorCode.CONFLICT, f"Query {q.query_id} is {q.state}.", query_id=q.query_id)

    def plan(self, query_id: str) -> dict:
        q = self._get(query_id)
        if q.plan is None:
            raise EngineError(ErrorCode.CONFLICT, f"Query {query_id} has no plan yet.", query_id=query_id)
        return q.plan

    def metrics(self, query_id: str) -> dict:
        q = self._get(query_id)
        self._succeeded(q)
        return q.diagnostics.as_dict()

    def explain_analyze(self, query_id: str) -> str:
        q = self._get(query_id)
        self._succeeded(q)
        return diagnostics.explain_analyze(q.diagnostics)

    def advice(self, query_id: str) -> dict:
        q = self._get(query_id)
        self._succeeded(q)
        return {"query_id": query_id, **advisor.advise(q.diagnostics)}

    def nodes(self) -> list[dict]:
        """Executors (and the driver) with their memory, from Spark's own registry."""
        status = self.engine.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        out, it = [], status.iterator()
        while it.hasNext():
            kv = it.next()
            out.append({"address": kv._1(), "max_memory": kv._2()._1(), "free_memory": kv._2()._2()})
        return out

    def close(self) -> None:
        self._pool.shutdown(wait=False, cancel_futures=True)

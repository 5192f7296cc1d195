"""What Spark did with a query: plans, effective rules, operator metrics, joins, shuffles, spills."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Operator:
    name: str
    detail: str
    metrics: dict[str, int]


@dataclass
class Join:
    name: str
    strategy: str  # broadcast or repartition
    build_bytes: int | None
    reliable: bool  # statistics came from the catalog, not from defaults


@dataclass
class Diagnostics:
    operators: list[Operator] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    shuffle_partitions: list[list[int]] = field(default_factory=list)
    rules: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0
    timeline: list[dict] = field(default_factory=list)
    stages: list[dict] = field(default_factory=list)

    def total(self, *names: str) -> int:
        return sum(o.metrics.get(n, 0) for o in self.operators for n in names)

    @property
    def shuffle_bytes(self) -> int:
        return self.total("shuffleBytesWritten")

    @property
    def spill_bytes(self) -> int:
        return self.total("spillSize")

    @property
    def spill_count(self) -> int:
        return sum(1 for o in self.operators if o.metrics.get("spillSize", 0) > 0)

    def as_dict(self) -> dict:
        return asdict(self) | {"shuffle_bytes": self.shuffle_bytes, "spill_bytes": self.spill_bytes}


def plans(df: DataFrame) -> dict:
    """The analysed, optimised and physical plans, the estimates, and the rules that changed something."""
    q = df._jdf.queryExecution()
    opt = q.optimizedPlan()
    stats = opt.stats()
    rows = stats.rowCount()
    return {
        "analyzed": q.analyzed().toString(), "optimized": opt.toString(), "physical": q.executedPlan().toString(), "rules": rules(df), "joins": join_decisions(q.executedPlan().toString()),
        "estimates": estimates(opt), "alternatives": alternatives(df.sparkSession, opt), "runtime_filters": runtime_filters(opt.toString() + q.executedPlan().toString()), "estimate": {"size_bytes": int(str(stats.sizeInBytes())), "rows": int(str(rows.get())) if rows.isDefined() else None},
    }


def _walk(node) -> list:
    out, it = [node], node.children().iterator()
    while it.hasNext():
        out += _walk(it.next())
    return out


def _size(node) -> tuple[int, int | None]:
    stats = node.stats()
    rows = stats.rowCount()
    return int(str(stats.sizeInBytes())), int(str(rows.get())) if rows.isDefined() else None


def estimates(optimized) -> list[dict]:
    """What the optimizer expects of each node, from the root down; rows only where tables have statistics."""
    return [{"node": n.nodeName(), "detail": n.simpleString(8)[:120], "size_bytes": _size(n)[0], "rows": _size(n)[1]} for n in _walk(optimized)]


def alternatives(spark: SparkSession, optimized) -> list[dict]:
    """For each join the strategies open to it, and why each is or is not taken before adaptive execution."""
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    out = []
    for n in _walk(optimized):
        if n.nodeName() != "Join":
            continue
        kind, sides = n.joinType().sql(), {"left": _size(n.left())[0], "right": _size(n.right())[0]}
        ways = []
        for side, size in sides.items():
            kept = {"left": ("LEFT", "FULL"), "right": ("RIGHT", "FULL")}[side]  # a side that keeps all its rows cannot be sent everywhere
            reason = f"{kind.lower()} joins keep the rows of that side" if kind.startswith(kept) else "broadcasts are off" if limit < 0 else f"{size} bytes are over {limit}" if size > limit else None
            ways.append({"strategy": "broadcast", "build": side, "size_bytes": size, "rejected": reason})
        fits = [w for w in ways if w["rejected"] is None]
        for w in fits[1:] if fits and fits[0]["size_bytes"] <= fits[-1]["size_bytes"] else fits[:-1]:
            w["rejected"] = "the other side is smaller"
        ways.append({"strategy": "repartition", "build": None, "size_bytes": sum(sides.values()), "rejected": "a side fits a broadcast" if fits else None})
        out.append({"join": n.simpleString(8)[:120], "alternatives": ways})
    return out


def runtime_filters(plan: str) -> dict[str, int]:
    """Filters that one side of a join makes for the other's scan."""
    return {"bloom": len(re.findall(r"might_contain\(", plan)), "dynamic_pruning": len(re.findall(r"dynamicpruning", plan))}


def join_decisions(physical: str) -> list[dict]:
    """The joins of a physical plan with their strategies and build sides."""
    found = re.findall(r"\b((?:BroadcastHash|SortMerge|ShuffledHash|BroadcastNestedLoop)Join|CartesianProduct)\b(.*)", physical)
    return [{"operator": op, "strategy": "broadcast" if op.startswith("Broadcast") else "repartition", "build": m[1].lower() if (m := re.search(r"Build(Left|Right)", rest)) else None} for op, rest in found]


def stages_of(sc, tag: str) -> list[dict]:
    """Spark's stages of the jobs with a tag: tasks, failures and attempts, as far as the driver still knows them."""
    tracker, out = sc._jsc.sc().statusTracker(), {}
    for job in tracker.getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        for stage in info.get().stageIds() if info.isDefined() else []:
            s = tracker.getStageInfo(stage)
            if s.isDefined():
                s = s.get()
                out[stage] = {"stage_id": stage, "job_id": job, "name": s.name()[:80], "tasks": s.numTasks(), "completed": s.numCompletedTasks(), "failed_tasks": s.numFailedTasks(), "attempt": s.currentAttemptId()}
                out[stage] |= _task_facts(sc, stage)
    return [out[k] for k in sorted(out)]


def _task_facts(sc, stage: int) -> dict:
    """Shuffled rows, times and the latest tasks of a stage's last attempt; a task's attempt counts its retries."""
    store = sc._jsc.sc().statusStore()
    try:
        s = store.lastStageAttempt(stage)
        tasks, it = [], store.taskList(stage, s.attemptId(), 1000).iterator()
        while it.hasNext():
            t = it.next()
            took = t.duration()
            tasks.append({"task": t.index(), "attempt": t.attempt(), "status": t.status(), "executor": t.executorId(), "milliseconds": took.get() if took.isDefined() else None})
        at = {k: v.get().getTime() / 1000 if v.isDefined() else None for k, v in (("submitted", s.submissionTime()), ("finished", s.completionTime()))}
        retries = sum(t["attempt"] > 0 for t in tasks)
        return {"shuffle_rows_read": s.shuffleReadRecords(), "shuffle_rows_written": s.shuffleWriteRecords(), "retries": retries, "task_attempts": sorted(tasks, key=lambda t: (t["task"], t["attempt"])), **at}
    except Py4JJavaError:  # the driver keeps facts of the latest stages only
        return {}


def rules(df: DataFrame) -> dict[str, int]:
    out, it = {}, df._jdf.queryExecution().tracker().rules().iterator()
    while it.hasNext():
        kv = it.next()
        n = kv._2().numEffectiveInvocations()
        if n:
            out[kv._1().rsplit(".", 1)[-1]] = n
    return out


def _children(node) -> list:
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    out, it = [], node.children().iterator()
    while it.hasNext():
        out.append(it.next())
    return out


def collect(df: DataFrame, seconds: float = 0.0) -> Diagnostics:
    """Of a DataFrame whose execution has run."""
    d = Diagnostics(seconds=seconds, rules=rules(df))
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop(0)
        name = node.getClass().getSimpleName().removesuffix("Exec")
        metrics, it = {}, node.metrics().iterator()
        while it.hasNext():
            kv = it.next()
            metrics[kv._1()] = max(0, kv._2().value())
        if name not in ("WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan") and not name.endswith("QueryStage"):
            d.operators.append(Operator(name, node.simpleStringWithNodeId()[:200], metrics))
        kids = _children(node)
        if name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin"):
            d.joins.append(_join(node, name))
        if name == "ShuffleExchange":
            _sizes(node, d)
        stack = kids + stack
    return d


def _join(node, name: str) -> Join:
    stats = []
    for side in (node.left(), node.right()):
        found, stack = None, [side]
        while stack and found is None:
            x = stack.pop(0)
            m = x.metrics()
            if m.contains("dataSize"):
                found = m.apply("dataSize").value()
            stack = _children(x) + stack
        stats.append(found)
    link = node.logicalLink()
    reliable = bool(link.isDefined() and link.get().stats().rowCount().isDefined())
    known = [s for s in stats if s is not None]
    return Join(re.sub(r"#\d+L?", "", node.simpleStringWithNodeId())[:120], "broadcast" if name.startswith("Broadcast") else "repartition", min(known) if known else None, reliable)


def _sizes(node, d: Diagnostics) -> None:
    try:
        stats = node.mapOutputStatisticsFuture().value().get().get()
        d.shuffle_partitions.append([int(x) for x in stats.bytesByPartitionId()] if stats is not None else [])
    except Exception:  # the exchange did not run in this plan
        d.shuffle_partitions.append([])


def explain_analyze(d: Diagnostics) -> str:
    lines = [f"time {d.seconds:.3f} s, shuffle {d.shuffle_bytes} B, spill {d.spill_bytes} B"]
    for o in d.operators:
        lines.append(f"{o.name}: " + ", ".join(f"{k}={v}" for k, v in sorted(o.metrics.items()) if v))
    lines += [f"stage {s['stage_id']}: {s['tasks']} tasks, {s['failed_tasks']} failed, attempt {s['attempt']}" for s in d.stages]
    return "\n".join(lines + [f"rule {k}: {n}" for k, n in sorted(d.rules.items())])

"""Deterministic advice from a query's diagnostics."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from statistics import median

from quarry.diagnostics import Diagnostics

MIB = 1 << 20
HIGH_SHUFFLE = 64 * MIB
SKEW_LEAST, SKEW_RATIO = MIB, 3.0
SPILL_CRITICAL, SPILLS_CRITICAL = 64 * MIB, 3
BROADCAST = 10 * MIB
_ORDER = {"critical": 0, "warning": 1, "info": 2}


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    message: str
    evidence: dict  # what was measured, and the threshold it passed
    cause: str
    effect: str  # of following the advice


def advise(d: Diagnostics) -> dict:
    """status and findings, by severity and then code."""
    out: list[Finding] = []
    for j in d.joins:
        if not j.reliable:
            out.append(Finding(f"MISSING_STATISTICS:{j.name}", "warning", "The join was planned without table statistics; analyse or import its tables.", {"join": j.name, "row_counts_known": False}, "Sizes were guessed from files, not rows.", "Join order and build side follow the data."))
        if j.build_bytes is not None and j.strategy == "repartition" and j.reliable and j.build_bytes <= BROADCAST:
            out.append(Finding(f"JOIN_BROADCAST_CANDIDATE:{j.name}", "info", "The smaller side would fit a broadcast.", {"build_bytes": j.build_bytes, "threshold": BROADCAST}, "Both sides were shuffled by the join key.", "The larger side stays where it is."))
        if j.build_bytes is not None and j.strategy == "broadcast" and j.build_bytes > BROADCAST:
            out.append(Finding(f"JOIN_BROADCAST_SIZE:{j.name}", "warning", "The broadcast side is large; repartition instead.", {"build_bytes": j.build_bytes, "threshold": BROADCAST}, "Every executor holds a copy of that side.", "Memory in proportion to a partition, for a shuffle of both sides."))
    if d.shuffle_bytes >= HIGH_SHUFFLE:
        out.append(Finding("HIGH_SHUFFLE", "warning", "Much data was shuffled; filter or project earlier, or bucket by the join key.", {"bytes": d.shuffle_bytes, "threshold": HIGH_SHUFFLE}, "Joins, groups and sorts move rows between executors.", "Less network and disk for the same rows."))
    for sizes in d.shuffle_partitions:
        if len(sizes) >= 2 and max(sizes) >= SKEW_LEAST:
            rest = sorted(sizes)[:-1]
            if (m := median(rest)) == 0 or max(sizes) / m >= SKEW_RATIO:
                out.append(Finding("SHUFFLE_SKEW", "warning", "One shuffle partition is much larger than the others.", {"largest": max(sizes), "median": m, "threshold": SKEW_RATIO, "least": SKEW_LEAST}, "Few keys hold many of the rows.", "The stage no longer waits for one task."))
                break
    if d.spill_bytes > 0:
        worst = d.spill_bytes >= SPILL_CRITICAL or d.spill_count >= SPILLS_CRITICAL
        out.append(Finding("OPERATOR_SPILL", "critical" if worst else "warning", "Operators spilled to disk; raise memory or the number of partitions.", {"bytes": d.spill_bytes, "operators": d.spill_count, "critical_bytes": SPILL_CRITICAL, "critical_operators": SPILLS_CRITICAL}, "Sorts, joins or groups were larger than their memory.", "No second pass over disk."))
    out.sort(key=lambda f: (_ORDER[f.severity], f.code))
    return {"status": "recommendations" if out else "no_recommendations", "findings": [asdict(f) for f in out]}

"""Order MinHash fingerprints: sketches of word k-mers that also remember their order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

K = 3  # tokens in a k-mer
PICKS = 2  # k-mers in a tuple
SIGNATURES = 64
TOKEN = 12  # longer words are cut to tokens of so many code points
_STEP = 1 << 13
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.random.default_rng(20).integers(0, 1 << 63, SIGNATURES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = np.random.default_rng(21).integers(0, 1 << 63, SIGNATURES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _kmers(text: str, known: dict[str, int]) -> np.ndarray:
    words = text.split()
    if any(len(w) > TOKEN for w in words):
        words = [w[i : i + TOKEN] for w in words for i in range(0, len(w), TOKEN)]
    try:
        tokens = [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        tokens = [known[w] for w in words]
    h = np.array(tokens, np.uint64)
    n = max(1, h.size - K + 1)
    k = np.zeros(n, np.uint64)
    for i in range(min(K, h.size)):
        k = _mix(k + h[i : i + n])
    return k if h.size else k[:0]


def fingerprint(text: str | None, known: dict[str, int] | None = None) -> bytes:
    """64 numbers of 16 bits, each of the PICKS least occurrence-numbered k-mers in text order.

    known: word digests to reuse; it is filled.
    """
    k = _kmers(text or "", {} if known is None else known)
    if not k.size:
        return b"\0\0" * SIGNATURES
    order = np.argsort(k, kind="stable")
    s = k[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    nth = np.empty(k.size, np.uint64)
    nth[order] = np.arange(k.size) - np.repeat(first, np.diff(np.r_[first, k.size]))
    h = _mix(k + nth * _B)
    picks = min(PICKS, k.size)
    rows = np.arange(SIGNATURES)
    best_v, best_at = np.empty((SIGNATURES, 0), np.uint64), np.empty((SIGNATURES, 0), np.int64)
    for at in range(0, h.size, _STEP):
        v = (h[None, at : at + _STEP] ^ _TURN[:, None]) * _ODD[:, None]
        for _ in range(min(picks, v.shape[1])):
            i = v.argmin(axis=1)
            best_v, best_at = np.c_[best_v, v[rows, i]], np.c_[best_at, i + at]
            v[rows, i] = np.iinfo(np.uint64).max
        if best_v.shape[1] > picks:
            keep = np.argsort(best_v, axis=1, kind="stable")[:, :picks]
            best_v, best_at = best_v[rows[:, None], keep], best_at[rows[:, None], keep]
    best_at.sort(axis=1)
    sig = np.zeros(SIGNATURES, np.uint64)
    for j in range(best_at.shape[1]):
        sig = _mix(sig * _A + k[best_at[:, j]])
    return (sig & np.uint64(0xFFFF)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many code points (or all) of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_EDGE = "part int, place int, text string"
_FIRST, _LAST = 0, 1


def _row(doc: int | None, text: str, fp: bytes, following: str, following_fp: bytes, known: dict[str, int]) -> tuple:
    changed = edited(text, following)
    g = fingerprint(changed, known)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), fp, g, likeness(fp, g), likeness(fp, following_fp)


def _batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Finished rows, and rows that only carry (doc_id, part, place, text)."""
    every = [(*r, None, None, None) for r in rows] + [(doc, *[None] * 6, part, place, text) for doc, part, place, text in edges]
    types = (*_TYPES, pa.int32(), pa.int32(), pa.string())
    names = [c.split()[0] for c in f"{_OUT}, {_EDGE}".split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*every) if every else [[]] * len(types), types)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition in order: a row for each document whose next is in it too; the first and last text, for its neighbours."""
    part = TaskContext.get().partitionId()
    known: dict[str, int] = {}
    before = None
    for b in batches:
        out, edges = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if len(known) > 1 << 18:
                known.clear()
            fp = fingerprint(text, known)
            if before:
                out.append(_row(*before, text, fp, known))
            else:
                edges.append((doc, part, _FIRST, text))
            before = (doc, text, fp)
        yield _batch(out, edges)
    if before:
        yield _batch([], [(before[0], part, _LAST, before[1])])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(doc, text, fingerprint(text), following, fingerprint(following), {}) for doc, text, following in zip(*[c.to_pylist() for c in b.columns])]
        made = [_row(*r) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 7, _TYPES)], [c.split()[0] for c in _OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs: doc_id long, text string. The next document is the next by id, then by XXH64 of its text; null
    ids come last; after the last comes the first. Null text counts as empty; texts without words have a
    fingerprint of zeros, fewer than 3 words are one k-mer. A single document is its own next.
    Repeated rows follow each other. Empty input: no rows.

    Texts are range-partitioned in this order, rows that agree in all by their place in the input, so
    that no id, nor null, is one task's work. A partition finishes all its documents but the last, which
    waits for the first of the next partition: two texts a partition are kept for that.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    d = d.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    made = written(d.select("doc_id", "text").mapInArrow(_rows, f"{_OUT}, {_EDGE}"))
    edges = made.where("part is not null")
    firsts = edges.where(F.col("place") == _FIRST).select("part", F.col("text").alias("following"))
    parts = firsts.select("part")  # numbers only: a row a partition
    turn = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    lasts = edges.where(F.col("place") == _LAST).select("doc_id", "text", "part").join(turn, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    names = [c.split()[0] for c in _OUT.split(", ")]
    out = made.where("part is null").select(*names).unionByName(pairs.mapInArrow(_edge_rows, _OUT))
    return out.select(*[F.lower(F.hex(n)).alias(n) if n.endswith(("sha256", "fingerprint")) else n for n in names])

"""Removal of repeated byte strings by a distributed suffix sort.

Which suffixes can repeat at all is found first: each 200-byte window is known by its anchor, the
48-byte string in it with the least hash, and consecutive windows with one anchor form a span. A
window can only repeat if its anchor does. Of spans that are equal by digest two go on, so digests
prune but do not decide. The suffixes of what is left are range-partitioned by the anchor's leading
bytes at sampled splitters, sorted by multikey quicksort in their buckets, and neighbours compared.
Splitters fall between anchors, and equal strings have equal anchors, so there is nothing left to
compare across boundaries. What the sort finds goes back to all spans by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import joined_salted, row_hash, text_runs, written

LENGTH = 200
ANCHOR = 48
HOT = 4096  # different spans with one anchor beyond which a bucket cannot hold them; their windows are matched by 128-bit digests
_CHUNK = 1 << 16  # bytes whose anchors are found together: arrays that stay in cache
_ROWS = 1 << 16  # spans in a batch, about
_BATCH = 4 << 20  # bytes of spans sorted together, at least
_CUT = 2 * LENGTH - ANCHOR  # bytes of the longest span, a multiple of 8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(buf: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a big-endian number; zeros follow the end."""
    x = np.zeros(buf.size + 8, np.uint64)
    x[: buf.size] = buf
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        y = x << np.uint64(bits)
        y[:-step] |= x[step:]
        x = y
    return x[: buf.size]


def _anchor_hashes(words: np.ndarray) -> np.ndarray:
    """Of the ANCHOR bytes that start at each place."""
    n = words.size - ANCHOR + 8
    h = (words[:n] ^ _M2) * _M1
    for k in range(8, ANCHOR, 8):
        h ^= h >> np.uint64(32)
        h = (h + words[k : k + n]) * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


def _least_in_windows(key: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of that width: of a block's tail and the next one's head."""
    n = key.size - width + 1
    padded = np.full(-(-key.size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: key.size] = key
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def spans_of(texts: list[bytes], digests: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Text, first window's start, number of windows, anchor's place from it, anchor's hash, digests (if asked for)."""
    width = LENGTH - ANCHOR + 1
    for a, b in text_runs(texts, _CHUNK):
        step = _CHUNK if b - a == 1 else sum(map(len, texts[a:b])) + 1
        for base in range(0, max(1, max(map(len, texts[a:b])) - LENGTH + 1), step) if b - a == 1 else (0,):
            parts = [t[base : base + step + LENGTH - 1] for t in texts[a:b]]
            data = b"".join(parts)
            buf = np.frombuffer(data, np.uint8)
            if buf.size < LENGTH:
                continue
            size = np.array([len(p) for p in parts])
            first = np.cumsum(size) - size
            words = _words(buf)
            h = _anchor_hashes(words)
            bits = np.uint64((1 << 21) - 1)
            key = (h & ~bits) | np.arange(h.size, dtype=np.uint64)
            at = (_least_in_windows(key, width) & bits).astype(np.int64)
            change = np.zeros(at.size + 1, np.int8)
            fits = size >= LENGTH
            change[first[fits]] = 1
            ends = first[fits] + size[fits] - LENGTH + 1
            np.add.at(change, ends, -1)
            valid = np.cumsum(change[:-1]).astype(bool)
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
            lo = np.nonzero(new)[0]
            if not lo.size:
                continue
            stop = valid.copy()
            stop[:-1] &= ~valid[1:] | new[1:]
            n = np.nonzero(stop)[0] - lo + 1
            text = np.searchsorted(first, lo, side="right") - 1
            digest = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist())] if digests else []
            anchor = at[lo]
            yield a + text, lo - first[text] + base, n, anchor - lo, h[anchor], digest


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of all spans and how often they come, already counted for a run of texts."""
    for b in batches:
        held = [x[4] for x in spans_of([t or b"" for t in b.column(0).to_pylist()], digests=False)]
        anchor, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "start", "n", "off", "anchor", "content"]
    for b in batches:
        texts = [t or b"" for t in b.column(1).to_pylist()]
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            text, start, n, off, anchor, digest = (np.concatenate(c) for c in zip(*held))  # noqa: B023
            signed = [x.view(np.int64) for x in (anchor, digest)]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(start), pa.array(n, pa.int32()), pa.array(off, pa.int32()), *map(pa.array, signed)], names)  # noqa: B023

        for *found, digest in spans_of(texts):
            held.append((*found, np.array(digest, np.uint64)))
            if sum(len(x[0]) for x in held) >= _ROWS:
                yield flush()
                held = []
        if held:
            yield flush()


def multikey_quicksort(words: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, step: int = 8) -> np.ndarray:
    """The order of the suffixes by group, then by their first length bytes.

    words: the big-endian 8 bytes at each place of the text, or at each step-th. Each round splits
    every open group by a pivot of its own into less, equal and greater at the group's depth; the
    equal go one word deeper. Single suffixes, and groups equal to the full length, have their final
    place. length counts as places of words do and is a multiple of step.
    """
    ids = np.argsort(group, kind="stable")
    group = group[ids]
    out, place = np.empty(at.size, np.int64), np.arange(at.size)
    depth = np.zeros(at.size, np.int64)
    while ids.size:
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        count = np.diff(np.r_[edge, group.size])
        keep = np.repeat(count > 1, count) & (depth < length)
        out[place[~keep]] = ids[~keep]
        ids, group, depth, place = ids[keep], group[keep], depth[keep], place[keep]
        if not ids.size:
            break
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        count = np.diff(np.r_[edge, group.size])
        w = words[at[ids] + depth]
        pivot = np.repeat(w[edge + count // 2], count)
        side = np.where(w > pivot, 2, w == pivot)
        number = np.repeat(np.arange(edge.size) * 3, count) + side
        order = np.argsort(number, kind="stable")
        ids, group = ids[order], number[order]
        depth = depth[order] + step * (side[order] == 1)
    return out


def equal_neighbours(words: np.ndarray, at: np.ndarray, group: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share their first length bytes with a neighbour of their group in the order."""
    pair = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    for depth in range(0, length, 8):
        pair = pair[words[at[order[pair]] + depth] == words[at[order[pair + 1]] + depth]]
    same = np.zeros(at.size, bool)
    same[order[pair]] = same[order[pair + 1]] = True
    return same


def equal_spans(segments: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each segment (anchor, n, off, text) one that has the same bytes at the same place of its anchor,
    the same for all of them, and whether there is another. Whole segments are sorted, neighbours compared."""
    words = np.frombuffer(b"".join([s[3].ljust(_CUT, b"\0") for s in segments]), ">u8").astype(np.uint64)
    length = _CUT // 8
    at = np.arange(len(segments)) * length
    group = np.unique(np.array([s[0] for s in segments]), return_inverse=True)[1] * LENGTH * LENGTH + np.array([s[1] * LENGTH + s[2] for s in segments])
    order = multikey_quicksort(words, at, group, length, 1)
    pair = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    for depth in range(length):
        pair = pair[words[at[order[pair]] + depth] == words[at[order[pair + 1]] + depth]]
    starts = np.ones(len(segments), bool)
    starts[pair + 1] = False
    run = np.cumsum(starts) - 1
    least = np.empty(len(segments), np.int64)
    least[order] = order[starts][run]
    several = np.empty(len(segments), bool)
    several[order] = (np.bincount(run) > 1)[run]
    return least, several


def repeated_windows(segments: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """For the windows of the segments (anchor, n, off, text), in order, whether another is equal."""
    n = np.array([s[1] for s in segments])
    size = np.array([len(s[3]) for s in segments])
    words = _words(np.frombuffer(b"".join(s[3] for s in segments), np.uint8))
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + rank
    anchor = np.unique([s[0] for s in segments], return_inverse=True)[1]
    off = np.array([s[2] for s in segments])[owner] - rank  # equal windows have their anchor at the same place
    group = anchor[owner] * LENGTH + off
    return equal_neighbours(words, at, group, multikey_quicksort(words, at, group, LENGTH), LENGTH)


def _true_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket, sorted by leading bytes and anchor: sorts whole anchor groups, first spans as they are,
    then, of anchors with different ones, the suffixes of each. Found ranges, from the span's start,
    come once for each content."""
    held: list[tuple] = []
    total = 0

    def flush() -> pa.RecordBatch:
        segments = [(anchor, n, off, cut) for anchor, _, _, n, off, cut in held]
        least, several = equal_spans(segments)
        kinds = np.unique(least)
        anchors = np.array([segments[i][0] for i in kinds])
        mixed = kinds[np.isin(anchors, anchors[np.r_[False, np.diff(anchors) == 0]])]  # anchors come together
        same = repeated_windows([segments[i] for i in mixed]) if mixed.size else np.empty(0, bool)
        runs: dict[int, list[tuple[int, int]]] = {}
        at = 0
        for i in mixed.tolist():
            runs[i] = _true_runs(same[at : at + segments[i][1]])
            at += segments[i][1]
        out = []
        for (anchor, content, first, n, _, _), i, whole in zip(held, least.tolist(), several.tolist()):
            if first:
                out += [(anchor, content, a, b - 1 + LENGTH) for a, b in ([(0, n)] if whole else runs.get(i, []))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, _FOUND)], ["anchor", "content", "lo", "hi"])

    for b in batches:
        for x in zip(*[c.to_pylist() for c in b.columns]):
            if total > _BATCH and x[0] != held[-1][0]:
                yield flush()
                held, total = [], 0
            held.append(x)
            total += len(x[5])
    if held:
        yield flush()


_FOUND = (pa.int64(), pa.int64(), pa.int32(), pa.int32())


def _lead(cut: bytes, off: int) -> int:
    """The anchor's first 8 bytes as a number in the order of the bytes."""
    return int.from_bytes(cut[off : off + 8], "big") - (1 << 63)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "content", "times", "first", "n", "off", "bytes", "lead", "hot"]
    held: list[pa.RecordBatch] = []
    for b in batches:
        spans = b.column(1).flatten()
        start, n, off = (spans.field(k).to_pylist() for k in ("start", "n", "off"))
        ends = np.cumsum(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)).tolist()
        texts, at, low = b.column(0), 0, 0
        for i, end in enumerate(ends):
            text = texts[i].as_py()
            cut = [text[s : s + k + LENGTH - 1] for s, k in zip(start[at:end], n[at:end])]
            lead = [_lead(c, o) for c, o in zip(cut, off[at:end])]
            mine = spans.slice(at, end - at)
            columns = {k: mine.field(k) for k in ("anchor", "content", "times", "first", "n", "off", "hot")} | {"bytes": pa.array(cut, pa.binary()), "lead": pa.array(lead, pa.int64())}
            held.append(pa.RecordBatch.from_arrays([columns[k] for k in names], names))
            at, low = end, low + sum(map(len, cut))
            if low > _BATCH:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, low = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for anchor, content, times, n, cut in zip(*[c.to_pylist() for c in b.columns]):
            two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(cut[i : i + LENGTH]) for i in range(n)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([anchor] * n), pa.array([content] * n), pa.array([times] * n), pa.array(range(n), pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])], ["anchor", "content", "times", "lo", "d1", "d2"])


def _merged(ranges: list[int]) -> list[list[int]]:
    """ranges: lo, hi, lo, hi and so on."""
    out: list[list[int]] = []
    for r in sorted(zip(ranges[::2], ranges[1::2])):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text, ranges in zip(*[c.to_pylist() for c in b.columns]):
            text, runs, at, kept = text or b"", _merged(ranges or []), 0, []
            for lo, hi in runs:
                kept.append(text[at:lo])
                at = hi
            left = b"".join(kept) + text[at:]
            out.append((doc, len(text), len(text) - len(left), len(runs), left, [dict(zip(("lo", "hi"), r)) for r in runs]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)


def repeated_ranges(d: DataFrame) -> DataFrame:
    """row, start, ranges (lo, hi from start): they cover every repeated 200-byte string. d: row, bytes.

    Texts are shuffled by row once: the exchange also serves the caller's join of d by row.
    """
    spans = d.select("row", "bytes").mapInArrow(_spans, "row binary, start long, n int, off int, anchor long, content long")
    anchors = d.select("bytes").mapInArrow(_anchors, "anchor long, n long")
    seen = written(anchors.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1").select("anchor"))
    del anchors
    cand = written(spans.join(seen.hint("shuffle_hash"), "anchor", "left_semi"))
    where = F.struct("row", "start", "n", "off")
    reps = written(cand.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(where).alias("least"), F.max(where).alias("most")))
    verdicts = written(_verdicts(d, reps))
    return joined_salted(cand.select("row", "start", "anchor", "content"), verdicts, ["anchor", "content"], "times").select("row", "start", "ranges")


def _verdicts(d: DataFrame, reps: DataFrame) -> DataFrame:
    """anchor, content, times, ranges (lo, hi from the span's start): what the sort finds of the spans in reps."""
    kinds = reps.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("anchor", F.lit(True).alias("hot"))
    kinds = written(kinds)
    any_hot = not kinds.isEmpty()
    two = F.array(F.struct("least.*", F.lit(True).alias("first")), F.when(F.col("times") > 1, F.struct("most.*", F.lit(False).alias("first"))))
    each = reps.select("anchor", "content", "times", F.explode(F.array_compact(two)).alias("x")).select("anchor", "content", "times", "x.*")
    each = each.join(kinds, "anchor", "left") if any_hot else each.withColumn("hot", F.lit(None).cast("boolean"))
    per = each.groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "times", "first", "start", "n", "off", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spans"))
    cut = d.join(per.hint("shuffle_hash"), "row").select("bytes", "spans")
    cut = cut.mapInArrow(_cut_out, "anchor long, content long, times long, first boolean, n int, off int, bytes binary, lead long, hot boolean")
    cut = written(cut) if any_hot else cut
    buckets = cut.where("not hot").repartitionByRange("lead", "anchor").sortWithinPartitions("lead", "anchor")
    found = buckets.select("anchor", "content", "first", "n", "off", "bytes").mapInArrow(_compare, "anchor long, content long, lo int, hi int")
    if any_hot:
        w = cut.where("hot and first").select("anchor", "content", "times", "n", "bytes").mapInArrow(_digests, "anchor long, content long, times long, lo int, d1 long, d2 long")
        w = written(w)
        twice = written(w.groupBy("d1", "d2").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 1"))
        again = joined_salted(w.select("anchor", "content", "lo", "d1", "d2"), twice.select("d1", "d2", "rows"), ["d1", "d2"], "rows")
        found = found.unionByName(again.select("anchor", "content", "lo", (F.col("lo") + LENGTH).alias("hi")))
    verdicts = found.groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return verdicts.join(reps.select("anchor", "content", "times"), ["anchor", "content"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), spans (removed ranges lo, hi).

    docs: doc_id long, text string; other columns are ignored. Every byte that lies in a 200-byte
    string which also starts elsewhere, in this document or another, goes. Null text counts as
    empty; texts under 200 bytes keep all. Repeated rows are repeats of each other, whatever their
    ids. Null ids are documents like others. Empty input: no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("bytes"))
    ranges = repeated_ranges(d).groupBy("row").agg(F.collect_set(F.struct("start", "ranges")).alias("spans"))
    flat = F.transform("spans", lambda s: F.flatten(F.transform(s["ranges"], lambda r: F.array(s["start"] + r["lo"], s["start"] + r["hi"]))))
    ranges = ranges.select("row", F.flatten(flat).alias("ranges"))
    both = d.join(ranges.hint("shuffle_hash"), "row", "left").select("doc_id", "bytes", "ranges")
    return both.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<lo:long,hi:long>>")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: All 200-byte strings by brute force.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, n - 200)) AS i FROM n WHERE n >= 200)),
dup AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING COUNT(*) > 1) USING (k)),
marked AS (SELECT doc_id, i, COALESCE(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, TRUE) AS fresh FROM dup),
numbered AS (SELECT doc_id, i, SUM(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT doc_id, run, MIN(i) AS lo, MAX(i) + 200 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT r.doc_id, lo, substring(h, 2 * COALESCE(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) + 1, 2 * (lo - COALESCE(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0))) AS piece, hi FROM runs r JOIN n USING (doc_id)),
sums AS (SELECT doc_id, COUNT(*) AS n_spans, SUM(hi - lo)::BIGINT AS n_removed, MAX(hi) AS last, string_agg(piece, '' ORDER BY lo) AS head FROM gaps JOIN runs USING (doc_id, lo, hi) GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
        sha256(unhex(COALESCE(head, '') || substring(h, 2 * COALESCE(last, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN sums s ON n.doc_id = s.doc_id
"""

"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
PIECE = 256  # what is left of a document after whole windows is cut into equal pieces of at most so many
FINE, EACH = 32, 25  # and, of each 25th document, of so many: they even out the last imbalances
GROUP = 1024  # pieces that are differenced together
END = 1  # follows each document
LONG_RUN = 20_000  # texts with longer unbroken runs go to the other, slower library
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids by a byte-level BPE file, as tokenizers makes them of the file as it is: the string of an
    added token in a text is that token. tiktoken makes the same ids several times faster, if the file's
    merges are in the order of their ids, of texts without such strings. What it cannot do in time that
    grows with the text, runs of over LONG_RUN without a break, tokenizers does; ids do not depend on it."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in set(self.added)}
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        in_order = all(vocab[t] == 256 + i for i, t in enumerate(made)) and len(ranks) == 256 + len(made)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if plain and in_order else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added) or len(text) > LONG_RUN and _longest_run(text) > LONG_RUN:
            got = self.slow.encode(text, add_special_tokens=False).ids
        else:
            got = self.fast.encode_ordinary(text)
        return np.array([*got, END], "<u4")


def _longest_run(text: str) -> int:
    space = np.array([c.isspace() for c in text])
    turns = np.nonzero(np.diff(space, prepend=~space[:1], append=~space[-1:]))[0]
    return int(np.diff(turns).max(initial=0))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's window and the windows' sums, by multiway differencing.

    Every item starts as a partial partition with one filled window. The two partitions of the
    largest spread merge, the fullest windows of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    sums: list[np.ndarray | None] = []
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(windows, np.int64)
        v[0] = s
        sums.append(v)
        heap.append((-s if windows > 1 else 0, i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merges.append((a, b, order))
        sums.append(both - both[-1])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(sums) - 1))
    place: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        now = np.empty(windows, np.int64)
        now[order] = place.pop(n + k)
        for child, seats in ((a, now), (b, now[::-1])):
            if child < n:
                out[child] = seats[0]
            else:
                place[child] = seats
    return out, np.bincount(out, weights=sizes, minlength=windows).astype(np.int64)


def windows_of(sizes: list[int], capacity: int = WINDOW) -> np.ndarray:
    """Each item's window; as few windows as differencing fills without exceeding capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        at, sums = difference(sizes, windows)
        if sums.max(initial=0) <= capacity:
            return at
        windows += 1


def _cut(n: int, capacity: int, piece: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of whole windows, and of the near-equal pieces of the rest."""
    whole = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    at, rest = len(whole) * capacity, n - len(whole) * capacity
    k = -(-rest // piece)
    ends = [at + rest * i // k for i in range(k + 1)] if k else []
    return whole, [(a, b - a) for a, b in zip(ends, ends[1:])]


def pack(docs: DataFrame, path: str, capacity: int = WINDOW, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """A row for each piece of a document: where it starts, its ids' digest, its window and place there.

    docs: doc_id long, text string. path: a byte-level BPE file, present on every executor. Each task
    packs what it reads, group by group, without a shuffle; only its last group may be short, so
    padding does not depend on how much there is. Null or empty text: its end token alone. Repeated
    rows and null ids are packed like others. Empty input: no rows. sequence_id has the partition
    in its upper bits, and a recomputed partition gives the same rows.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seq = encoder(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        waiting: list[tuple] = []
        cut = 0

        def rows(got: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * len(names))], names)

        def flush(items: list[tuple]) -> list[tuple]:
            nonlocal seq
            at = windows_of([x[2] for x in items], capacity)
            fill: dict[int, int] = {}
            ids = {w: seq + i for i, w in enumerate(dict.fromkeys(at.tolist()))}
            seq += len(ids)
            out = []
            for x, w in zip(items, at.tolist()):
                out.append((*x, ids[w], fill.get(w, 0)))
                fill[w] = fill.get(w, 0) + x[2]
            return out

        for b in it:
            done = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = e.ids(text or "")
                whole, rest = _cut(len(ids), capacity, piece if cut % EACH else FINE)
                cut += bool(rest)
                make = lambda s, n: (doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids))  # noqa: B023, E731
                for s, n in whole:
                    done.append((*make(s, n), seq, 0))
                    seq += 1
                waiting += [make(s, n) for s, n in rest]
                while len(waiting) >= group:
                    done += flush(waiting[:group])
                    waiting = waiting[group:]
            yield rows(done)
        if waiting:
            yield rows(flush(waiting))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(batches, SCHEMA)

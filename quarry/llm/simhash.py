"""SimHash near-duplicates: fingerprints, a grid join on segment popcounts, exact checks, components.

The embedding maps a fingerprint to the bit counts of its 32 two-bit segments; the Manhattan distance of
two embeddings is at most the Hamming distance of the fingerprints. The range join, Manhattan distance at
most 3, is done as equi-joins: the segments fall into blocks, a distance of 3 touches at most 3 of them,
so two vectors in range agree in all others, and each choice of the others is one grid whose cells join on
equality. Neighbouring cells of one coarse grid would have to be joined instead if segments were few and
long, but counts of long segments of random bits crowd around their mean (of 8-bit segments over half are
3 to 5), so almost all pairs would be in range of each other.

What a cell does depends on how many different fingerprints it holds, the result does not: up to PAIRED
all pairs are compared in the join; up to SWEPT one task links them (n^2 / 2 comparisons of bits, a
forest of fewer than n links comes out); of more, any two within 3 bits have a point between them that is
1 bit from one and at most 2 from the other, and meet there (65 and 2081 rows a fingerprint, n times a
constant, so there is no quadratic work left).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, checkpointed, column_values, row_hash
from quarry.llm.components import connected

SHINGLE = 3
SEED = 42
DISTANCE = 3
PAIRED = 64  # fingerprints of a grid cell up to which the join pairs them
SWEPT = 20_000  # fingerprints of a grid cell up to which one task links them; more meet at midpoints
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STEP = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed long; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        stop = min(n, at + _STEP)
        if width == 3 and len(words) >= 3:
            h = [digest(b"%b %b %b" % t, SEED) for t in zip(words[at:stop], words[at + 1 : stop + 1], words[at + 2 : stop + 2])]
        else:
            h = [digest(b" ".join(words[i : i + width]), SEED) for i in range(at, stop)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(t) for t in column_values(b, "text")], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["doc_id", "row", "fp"])


def _mask(fields: range) -> int:
    m = sum(3 << 2 * f for f in fields)
    return m - (1 << 64) if m >> 63 else m


def _embedded(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, in unary: Manhattan distance is bit_count of the XOR."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within distance connect, fewer than there are fingerprints."""
    root = np.arange(len(fps))
    out = []
    bits = fps.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    for i in range(len(fps)):
        near = np.nonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= distance)[0] + i + 1
        for r in np.unique(root[near]):
            if r != root[i]:
                out.append((int(fps[i]), int(fps[near[root[near] == r][0]])))
                root[root == r] = root[i]
    return out


def _link_cell(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_forest(cell["fp"].to_numpy(), DISTANCE), columns=["a", "b"], dtype="int64")


def blocks_for(n: int) -> int:
    """Grid blocks for n fingerprints: with more of them there are more grids, but unlike
    fingerprints rarely share a cell (6: some 10^-7 of all pairs do in each grid, 9: 10^-10)."""
    return 6 + sum(n > most for most in (20_000_000, 200_000_000, 2_000_000_000))


def links(fps: DataFrame, blocks: int = 6) -> DataFrame:
    """Pairs a, b of fingerprints, enough to connect all that differ in at most 3 bits.

    fps: distinct fp. The grid: the 32 segment popcounts fall into blocks; vectors within Manhattan
    distance 3 agree in all but 3 of the blocks, so each choice of blocks - 3 of them is one grid
    whose cells are equal counts there. Pairs of a cell are held against the Manhattan bound, then
    the exact distance. A cell of many fingerprints yields a spanning forest, not all pairs; beyond
    SWEPT its fingerprints meet at midpoints: one flips up to 1 bit, the other up to 2.
    """
    edges = [round(i * 32 / blocks) for i in range(blocks + 1)]
    grids = list(combinations([_mask(range(a, b)) for a, b in zip(edges, edges[1:])], blocks - DISTANCE))
    masks = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(_or(g)).alias("mask")) for i, g in enumerate(grids)])
    e = fps.select("fp", _embedded(F.col("fp")).alias("e")).withColumn("g", F.explode(masks))
    e = e.select("fp", "e", "g.grid", F.col("e").bitwiseAND(F.col("g.mask")).alias("cell"))
    size = e.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    e = checkpointed(e.join(size, ["grid", "cell"]))
    small = e.where(F.col("n") <= PAIRED)
    b = small.select("grid", "cell", F.col("fp").alias("b"), F.col("e").alias("f"))
    pairs = small.select("grid", "cell", F.col("fp").alias("a"), "e").join(b, ["grid", "cell"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("e").bitwiseXOR(F.col("f"))) <= DISTANCE))
    out = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    most = e.agg(F.max("n")).first()[0] or 0
    if most > PAIRED:
        mid = e.where((F.col("n") > PAIRED) & (F.col("n") <= SWEPT))
        out = out.unionByName(mid.groupBy("grid", "cell").applyInPandas(_link_cell, "a long, b long"))
    if most > SWEPT:
        out = out.unionByName(_midpoints(e.where(F.col("n") > SWEPT).select("fp").distinct()))
    return out


def _or(masks: tuple[int, ...]) -> int:
    m = 0
    for x in masks:
        m |= x
    return m


def _flips(bits: int) -> list[int]:
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << i for i in c)) for k in range(bits + 1) for c in combinations(range(64), k)]


def _midpoints(fps: DataFrame) -> DataFrame:
    """All within 2 bits of a point x join all within 1 bit of it, if there are any: a star for each x."""
    near = lambda n: fps.select("fp", F.explode(F.transform(F.lit(_flips(n)), lambda m: F.col("fp").bitwiseXOR(m))).alias("x"))
    hub = near(1).groupBy("x").agg(F.min("fp").alias("a"))
    return near(2).join(hub, "x").where("a <> fp").select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, row, fp (signed long), component_id: for each document the least id it is linked to.

    docs: doc_id long, text string; other columns are ignored. Fingerprints differing in at most 3
    of 64 bits link. row tells rows of one id apart. Null text counts as empty; texts without words
    have fingerprint 0, linked like any other; fewer than 3 words are one shingle. Repeated rows
    share a component. A component whose ids are all null has a null component_id. Empty: no rows.
    blocks: of the grid, 4 or more; by default as many as the number of fingerprints asks for.
    """
    rows = docs.select("doc_id", row_hash("doc_id", "text").alias("row"), "text")
    d = checkpointed(rows.mapInArrow(_fingerprints, "doc_id long, row binary, fp long"))
    reps = checkpointed(d.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = connected(links(reps.select("fp"), blocks or blocks_for(reps.count())), "a", "b")
    reps = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    return d.join(reps.select("fp", "root").join(least, "root"), "fp").select("doc_id", "row", "fp", "root", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

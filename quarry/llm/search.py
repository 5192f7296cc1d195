"""Exact top-k by inner product: vectors in buckets of like length, pruned by local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

TOP = 5
BUCKET = 2048  # vectors
QUERIES = 256  # in a block
FIRST = 2048  # longest vectors, at most, that give each query its first threshold
STEEP = 0.5  # local cosine threshold from which coordinates prune
FOCUS = 4  # coordinates that do
RANGES = 64  # of the buckets' lengths, at most
CELLS = 64  # of candidates, at least, where there are as many buckets
BLOCK_BYTES, CELL_BYTES = 4 << 20, 32 << 20  # of a block's components as doubles; of a cell's candidates, or its queries, as they are packed
_EXACT, _EXACT_SINGLE, _SHORT = float(1 << 53), float(1 << 24), float(1 << 15)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array of doubles: floor(256 x)), norm, dims of the vectors that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = x.where(fine).select("id", F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))
    return v.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("norm"), F.size("v").alias("dims"))


def _packed(rows: int):
    """Runs of up to so many vectors of one dimension, in the order they come, longest first.
    Components are 16-bit integers where all of a block fit, else doubles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            m = np.array([x[1] for x in held], "<f8").reshape(len(held), held[0][3])
            m = m.astype("<i2") if np.abs(m).max(initial=0) < _SHORT else m
            norm = np.array([x[2] for x in held], "<f8")
            cols = [[np.array([x[0] for x in held], "<i8").tobytes()], [m.tobytes()], [norm.tobytes()], [float(norm.max())], [held[0][3]], [len(held)], [m.nbytes + 16 * len(held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.int64()))], ["ids", "vectors", "norms", "longest", "dims", "n", "size"])

        for b in it:
            for x in zip(*[c.to_pylist() for c in b.columns]):
                if held and (len(held) >= min(rows, BLOCK_BYTES // (8 * max(1, x[3]))) or x[3] != held[0][3]):
                    yield block()
                    held = []
                held.append(x)
        if held:
            yield block()

    return batches


_BLOCK = "ids binary, vectors binary, norms binary, longest double, dims int, n int, size long"


def _blocks(v: DataFrame, rows: int) -> DataFrame:
    v = v.repartitionByRange("dims", F.desc("norm"), "id").sortWithinPartitions("dims", F.desc("norm"), "id")
    return v.select("id", "v", "norm", "dims").mapInArrow(_packed(rows), _BLOCK)


def _unpack(ids: bytes, vectors: bytes, norms: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    kind = "<i2" if len(vectors) == 2 * i.size * dims else "<f8"
    return i, np.frombuffer(vectors, kind).reshape(i.size, dims), np.frombuffer(norms, "<f8")


def _single(m: np.ndarray, longest: float) -> np.ndarray | None:
    """In single precision, if that is exact."""
    return m.astype("<f4") if longest < _EXACT_SINGLE else None


def _products(c: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Integer products: exact in doubles below 2^53, else by Python's integers, held to long's range."""
    if bound < _EXACT:
        return (c @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in c]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in exact], np.int64)


def best_of(qid: int, q: np.ndarray, q_norm: float, ids: np.ndarray, c: np.ndarray, norms: np.ndarray, floor: float, top: int) -> list[tuple[int, int]]:
    """(score, id) of the top candidates scoring at least floor. Candidates come longest first.

    By length: only a prefix of the bucket can reach floor. By coordinates: where the local cosine
    threshold t = floor / (|q| longest) is steep, a unit vector within it differs from the query in
    each coordinate x by no more than x (1 - t) + sqrt((1 - t^2)(1 - x^2)), so the query's largest
    coordinates rule most out. What is left is verified by the product.
    """
    at = np.arange(ids.size)
    if floor > 0 and q_norm > 0:
        at = at[: np.searchsorted(-norms, -(floor / q_norm) * (1 - 1e-9), side="right")]
        if at.size:
            t = floor / (q_norm * norms[0]) * (1 - 1e-9)
            if STEEP <= t <= 1:
                unit = q / q_norm
                for f in np.argsort(-np.abs(unit))[:FOCUS]:
                    reach = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-9
                    x = c[at, f] / norms[at]
                    low = unit[f] * t - reach if unit[f] > 0 else unit[f] - reach - (1 - t)
                    high = unit[f] * t + reach if unit[f] < 0 else unit[f] + reach + (1 - t)
                    at = at[(x >= low) & (x <= high)]
    at = at[ids[at] != qid]
    if not at.size:
        return []
    s = _products(c[at], q, q_norm * norms[0] * 1.0001 + 1)
    keep = s >= floor
    s, i = s[keep], ids[at][keep]
    order = np.lexsort((i, -s))[:top]
    return list(zip(s[order].tolist(), i[order].tolist()))


class _Queries:
    """A block of queries, the best candidates seen of each, and the score that the next must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, floors: np.ndarray, top: int):
        self.ids, self.vectors, self.norms, self.floors, self.top = ids, vectors, norms, floors.copy(), top
        self.longest = float(norms.max(initial=0))
        self.single = _single(vectors, self.longest)
        self.found, self.scores, self.count = np.zeros((ids.size, top), np.int64), np.zeros((ids.size, top), np.int64), np.zeros(ids.size, np.int64)

    def meet(self, ids: np.ndarray, c: np.ndarray, norms: np.ndarray, single: np.ndarray | None) -> None:
        """A bucket, longest first, in doubles and by _single. Queries that only length can prune share
        one product with the longest prefix that one of them needs; the others go to best_of one by one."""
        bound = self.longest * norms[0] * 1.0001 + 1
        reach = np.divide(self.floors, self.norms, out=np.full(self.ids.size, -np.inf), where=(self.floors > 0) & (self.norms > 0)) * (1 - 1e-9)
        live = reach <= norms[0]
        together = live & (reach < STEEP * norms[0]) & (bound < _EXACT)
        for j in np.flatnonzero(live & ~together):
            got = best_of(int(self.ids[j]), self.vectors[j].astype("<f8"), float(self.norms[j]), ids, c, norms, float(self.floors[j]), self.top)
            if got:
                self._add(j, np.array([i for _, i in got], np.int64), np.array([x for x, _ in got], np.int64))
        at = np.flatnonzero(together)
        if not at.size:
            return
        n = int(np.searchsorted(-norms, -reach[at].min(), side="right"))
        # Sums of integers are exact below 2^24 in single precision, whatever their order.
        exact = bound < _EXACT_SINGLE and self.single is not None and single is not None
        s = self.single[at] @ single[:n].T if exact else self.vectors[at].astype("<f8") @ c[:n].T
        hit, where = np.nonzero(s >= self.floors[at].astype(s.dtype)[:, None])
        ends = np.searchsorted(hit, np.arange(at.size + 1))
        for k in np.flatnonzero(np.diff(ends)):
            j, w = at[k], where[ends[k] : ends[k + 1]]
            w = w[ids[w] != self.ids[j]]
            if w.size:
                self._add(j, ids[w], s[k, w].astype(np.int64))

    def _add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        i, s = np.concatenate([self.found[j, : self.count[j]], ids]), np.concatenate([self.scores[j, : self.count[j]], scores])
        order = np.lexsort((i, ~s))[: self.top]
        n = self.count[j] = order.size
        self.found[j, :n], self.scores[j, :n] = i[order], s[order]
        if n == self.top:
            self.floors[j] = max(self.floors[j], s[order[-1]])


def _first(c: DataFrame) -> dict[int, list[tuple]]:
    """By dimension, the longest buckets with up to FIRST vectors and 2 x BLOCK_BYTES in all. The driver gets no
    others: they are chosen by their lengths and numbers, a few of which come from each partition."""
    chosen, n, size = [], 0, 0
    for r in c.select("longest", "block", "n", "size").orderBy(F.desc("longest"), "block").limit(16).collect():
        n, size = n + r["n"], size + r["size"]
        if chosen and (n > FIRST or size > 2 * BLOCK_BYTES):
            break
        chosen.append(r["block"])
    first: dict[int, list[tuple]] = {}
    for r in c.where(F.col("block").isin(chosen)).orderBy(F.desc("longest"), "block").collect() if chosen else []:
        first.setdefault(r["dims"], []).append((bytes(r["ids"]), bytes(r["vectors"]), bytes(r["norms"])))
    return first


def _thresholds(first, top: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for ids, vectors, norms, _, dims, n, size in zip(*[c.to_pylist() for c in b.columns]):
                qi, q, qn = _unpack(ids, vectors, norms, dims)
                block = _Queries(qi, q, qn, np.full(qi.size, -np.inf), top)
                for packed in first.value.get(dims, []):
                    ci, c, cn = _unpack(*packed, dims)
                    block.meet(ci, c.astype("<f8"), cn, _single(c, cn[0]))
                low = block.floors
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(low > 0, low / np.maximum(qn, 1e-300), 0.0)
                rows.append((ids, vectors, norms, dims, size, low.astype("<f8").tobytes(), float(need.min(initial=np.inf))))
            types = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], ["q_ids", "q_vectors", "q_norms", "dims", "size", "floors", "need"])

    return batches


def _matched(top: int):
    """What a cell's queries find among its candidates."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] * 4]
        if left.num_rows and right.num_rows:
            cell, dims = left["cell"][0].as_py(), left["dims"][0].as_py()
            queries = [(need, _Queries(*_unpack(i, v, n, dims), np.frombuffer(floors, "<f8"), top)) for i, v, n, floors, need in zip(*[left[c].to_pylist() for c in ("q_ids", "q_vectors", "q_norms", "floors", "need")])]
            longest = right["longest"].to_pylist()
            for at in sorted(range(len(longest)), key=lambda k: -longest[k]):
                ids, c, norms = _unpack(*[right[name][at].as_py() for name in ("ids", "vectors", "norms")], dims)
                double, single = c.astype("<f8"), _single(c, norms[0])
                for need, q in queries:
                    if longest[at] >= need * (1 - 1e-9):
                        q.meet(ids, double, norms, single)
            for _, q in queries:
                filled = np.arange(top) < q.count[:, None]
                out.append([np.repeat(q.ids, q.count), np.full(q.count.sum(), cell), q.found[filled], q.scores[filled]])
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["query_id", "cell", "vec_id", "score"])

    return found


def _placed(q: DataFrame, c: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both with cell and share: buckets of like length share a range of cells, evenly dealt within; a query
    block goes only to the ranges whose longest vector can reach its threshold. Beyond CELL_BYTES of
    queries, each block is in one of several shares, and candidates meet every share.

    A cell holds about CELL_BYTES of candidates, so queries are copied once for each of these and no
    more: copying them for each bucket grows with the square of the input."""
    parts = int(min(RANGES, blocks))
    total = c.agg(F.sum("size")).first()[0] or 0
    wanted = min(blocks, max(CELLS, -(-total // CELL_BYTES)))
    shares = max(1, -(-(q.agg(F.sum("size")).first()[0] or 0) // CELL_BYTES))
    cuts = sorted(set(c.approxQuantile("longest", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    c = c.withColumn("range", F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("longest"))) if cuts else F.lit(0))
    ranges, at = [], 0
    for r in c.groupBy("range").agg(F.max("longest").alias("most"), F.count("*").alias("n")).orderBy("range").collect():  # at most RANGES rows
        cells = max(1, r["n"] * wanted // blocks)
        ranges.append((r["range"], float(r["most"]), at, cells))
        at += cells
    ranges = ranges or [(0, 0.0, 0, 1)]
    own = F.element_at(F.create_map(*[x for r, _, lo, n in ranges for x in (F.lit(r), F.struct(F.lit(lo).alias("lo"), F.lit(n).alias("n")))]), F.col("range"))
    c = c.withColumn("own", own).withColumn("cell", (F.col("own.lo") + F.pmod(F.xxhash64("ids"), F.col("own.n"))).cast("int")).drop("own", "range")
    listed = F.array(*[F.struct(F.lit(most).alias("most"), F.sequence(F.lit(lo), F.lit(lo + n - 1)).alias("cells")) for _, most, lo, n in ranges])
    near = F.filter(listed, lambda r: r["most"] >= F.col("need") * (1 - 1e-9))
    q = q.withColumn("share", F.pmod(F.xxhash64("q_ids"), F.lit(shares)).cast("int"))
    c = c.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return q.withColumn("cell", F.explode(F.flatten(F.transform(near, lambda r: r["cells"])))), c


def top_products(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's candidates of the highest integer inner products.

    vectors: an id (long) and a vector (array of float or double). Components become floor(256 x).
    queries: which rows are queries, in terms of id; candidates are all rows of other ids. Ties go to
    the smaller id. Null ids or vectors, and vectors with null or non-finite components, take no
    part; vectors of different dimension do not meet; empty ones score 0. Rows of one id are one
    another's own: a query's equals by id are no candidates, and repeated queries answer once. A
    product beyond long's range counts as the end of the range. Empty input: no rows.

    Queries meet candidates block by block; a block pair is skipped if no query's threshold, from the
    longest vectors, can be reached in the bucket, and before the shuffle if in none of its range.
    Within a cell thresholds rise by what was found. Cells are cogrouped, so no join can be turned
    into a broadcast of all queries' copies, and the driver holds the longest buckets only.
    """
    v = written(quantised(vectors, id_col, vector_col))
    spark = vectors.sparkSession
    c = written(_blocks(v, BUCKET).withColumn("block", F.monotonically_increasing_id()))
    first = spark.sparkContext.broadcast(_first(c))
    q = written(_blocks(v.where(queries).dropDuplicates(["id"]), QUERIES).mapInArrow(_thresholds(first, top), "q_ids binary, q_vectors binary, q_norms binary, dims int, size long, floors binary, need double"))
    blocks = max(1, c.count())
    q, c = _placed(q, c, blocks)
    keys = ["cell", "share", "dims"]
    q = q.select(*keys, "q_ids", "q_vectors", "q_norms", "floors", "need").groupBy(*keys)
    c = c.select(*keys, "ids", "vectors", "norms", "longest").groupBy(*keys)
    got = q.cogroup(c).applyInArrow(_matched(top), "query_id long, cell long, vec_id long, score long")
    # A query that all cells may answer, such as a common vector, has its best found by parts of the cells first.
    got = got.withColumn("part", F.pmod("cell", F.lit(max(1, round(min(blocks, CELLS) ** 0.5)))))
    for keys in (["query_id", "part"], ["query_id"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        got = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return got.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

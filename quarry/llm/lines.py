"""Line dedup: sharded cuckoo filters in front of exact reference-count tables; reversible.

The exact table counts, for each line key, the documents that hold it and their largest id. A
shard's filter has the keys whose count reaches the threshold. A document's lines are first held
against the filter of their shard; only what passes meets the exact table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, LOWER, UPPER, checkpointed, row_hash, short_batches
from quarry.llm.cuckoo import CuckooFilter, Full

LEAST_CHARS = 20
LEAST_DOCS = 3
SHARDS = 64  # at least
SHARD_POSTINGS = 1 << 20  # in a shard, about, so that filters do not grow with the input
PACKET = 20_000  # line keys probed together, about
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_keys(text: str | None) -> list[bytes | None]:
    """For each line a 128-bit digest of its key, or None if the key is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(BLANKS)
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").translate(_FOLD)) if len(key) >= LEAST_CHARS else None)
    return out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [sorted({k for k in line_keys(t) if k}) for t in b.column(2).to_pylist()]
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        two = np.frombuffer(b"".join(k for ks in keys for k in ks), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(two[:, 0]), pa.array(two[:, 1])], ["doc_id", "row", "k1", "k2"])


def postings(docs: DataFrame) -> DataFrame:
    """A row for each document and distinct line key: doc_id, row, k1, k2."""
    short_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("doc_id", "text").alias("row"), "text")
    return d.mapInArrow(_postings, "doc_id long, row binary, k1 long, k2 long")


def sharded(posted: DataFrame, shards: int) -> DataFrame:
    return posted.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))


def reference_counts(posted: DataFrame) -> DataFrame:
    """The exact table: shard, k1, k2, n_docs, last_doc. Sums are formed before the shuffle."""
    return posted.groupBy("shard", "k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of(rows["k1"].to_numpy()).to_bytes()]})


def _updated(key: tuple, old: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter without the keys that fell below the threshold and with those that reached it; none if full."""
    came = turns.loc[turns["comes"], "k1"].to_numpy()
    f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(len(came))
    f.delete(turns.loc[~turns["comes"], "k1"].to_numpy())
    try:
        f.insert(came)
        data = f.to_bytes()
    except Full:
        data = None
    return pd.DataFrame({"shard": [key[0]], "filter": [data]})


def filters(refs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A cuckoo filter for each shard of the exact table: shard, filter. More shards keep each small."""
    return refs.where(F.col("n_docs") >= least_docs).select("shard", "k1").groupBy("shard").applyInPandas(_build, "shard int, filter binary")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, packet in zip(b.column(0), b.column(1)):
            v = packet.values
            k1 = v.field("k1").to_numpy(zero_copy_only=False)
            hit = pa.array(CuckooFilter.from_bytes(data.as_py()).contains(k1))
            yield pa.RecordBatch.from_arrays([v.field(n).filter(hit) for n in ("doc_id", "row", "k1", "k2")], ["doc_id", "row", "k1", "k2"])


def probed(posted: DataFrame, made: DataFrame, count: int, shards: int) -> DataFrame:
    """The postings whose key its shard's filter may hold. Postings travel in packets, so that a
    filter is sent once for many of them; a hot shard has more packets, not larger ones."""
    salts = max(1, count // (shards * PACKET))
    packets = posted.groupBy("shard", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("doc_id", "row", "k1", "k2")).alias("packet"))
    return packets.join(made, "shard").select("filter", "packet").mapInArrow(_probe, "doc_id long, row binary, k1 long, k2 long")


def decisions(posted: DataFrame, refs: DataFrame, made: DataFrame, count: int, least_docs: int, shards: int) -> DataFrame:
    """For each row of documents the keys it loses: row, drop (array of k1, k2). count: of postings."""
    hot = refs.where(F.col("n_docs") >= least_docs).select("k1", "k2", "last_doc")
    lost = probed(posted, made, count, shards).join(hot, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("row").agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))


def _rebuilt(names: tuple[str, str, str]):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = (text or "").split("\n")
                if drop:
                    gone = {np.array([d["k1"], d["k2"]], "<i8").tobytes() for d in drop}
                    stay = [x for x, k in zip(lines, line_keys(text)) if k not in gone]
                else:
                    stay = lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay) if drop else text)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(n_lines), pa.array(n_dropped), pa.array(kept, pa.string())], [*b.schema.names[2:], *names])

    return batches


NAMES = ("n_lines", "n_dropped", "kept")


def without(docs: DataFrame, lost: DataFrame, keep: list[str], names: tuple[str, str, str] = NAMES) -> DataFrame:
    """keep (columns of docs), n_lines, n_dropped, kept: the text without its lost lines. Texts are shuffled once."""
    d = docs.select(*keep, F.col("text").alias("quarry_text"), row_hash(F.col("doc_id"), F.col("text")).alias("quarry_row"))
    lost = lost.select(F.col("row").alias("quarry_row"), F.col("drop").alias("quarry_drop"))
    d = d.join(lost.hint("shuffle_hash"), "quarry_row", "left").select("quarry_text", "quarry_drop", *keep)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return d.mapInArrow(_rebuilt(names), f"{types}, `{names[0]}` long, `{names[1]}` long, `{names[2]}` string")


def dedup_lines(docs: DataFrame, keep: list[str], least_docs: int = LEAST_DOCS, shards: int = SHARDS, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """keep (columns of docs), n_lines, n_dropped, kept, the last three under the given names.

    Lines are split at \\n; a key is the line without blanks at its ends, A-Z as a-z. Keys of 20 code
    points or more in at least 3 documents (rows, whatever their ids) go, except in the largest
    doc_id holding them; rows that share that id all keep them. Null or empty text: one empty line,
    kept as it is (null or empty). Null ids are below all others; if all holders' ids are null none drops.
    Empty input: no rows. shards: at least so many; they do not change the result.
    """
    posted = checkpointed(postings(docs))
    count = posted.count()
    shards = max(shards, -(-count // SHARD_POSTINGS))
    posted = sharded(posted, shards)
    refs = checkpointed(reference_counts(posted))
    return without(docs, decisions(posted, refs, filters(refs, least_docs), count, least_docs, shards), keep, names)


class LineIndex:
    """Incremental, reversible line dedup: documents come and go, counts and filters follow.

    folder holds the exact reference table, refs (shard, k1, k2, doc_id, row, copies), and a cuckoo
    filter for each shard. A change reads, merges and writes anew only the shards that its lines fall
    into; the manifest of a version names, for each shard, the version that wrote it last. Keys that
    a change carries over the threshold, up or down, enter or leave their shard's filter; one that
    gets full is built anew from its shard's counts. When shards hold more than twice SHARD_POSTINGS
    on average their number doubles and all are dealt anew, so shards and filters stay small and the
    cost is spread over the changes that led there. Deleting what was inserted restores all earlier
    decisions. A failed change leaves the version before. Null or empty texts post nothing; a change
    without documents makes a version that equals the one before. version: that of an index in
    folder to go on with; 0 begins a new one. rows_read: of refs, by the last change or apply.
    """

    def __init__(self, spark, folder: str, shards: int = SHARDS, least_docs: int = LEAST_DOCS, version: int = 0):
        self.spark, self.folder, self.least_docs = spark, folder.rstrip("/"), least_docs
        self.version, self.shards, self.at, self.rows_read = version, shards, {}, 0
        if version:
            for r in spark.read.parquet(f"{self.folder}/manifest-{version}").collect():  # a row a shard
                self.shards = r["shards"]
                if r["shard"] is not None:
                    self.at[r["shard"]] = (r["version"], r["n"])

    def _of(self, kind: str, schema: str, shards: list[int] | None) -> DataFrame:
        """Rows of the given (or all) shards of a table, each from the version that wrote it last."""
        out = self.spark.createDataFrame([], schema)
        by: dict[int, list[int]] = {}
        for s in self.at if shards is None else shards:
            if s in self.at:
                by.setdefault(self.at[s][0], []).append(s)
        for v, mine in sorted(by.items()):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}-{v}").where(F.col("shard").isin(mine)))
        return out

    def refs(self, shards: list[int] | None = None) -> DataFrame:
        return self._of("refs", "shard int, k1 long, k2 long, doc_id long, row binary, copies long", shards)

    def filters(self, shards: list[int] | None = None) -> DataFrame:
        return self._of("filters", "shard int, filter binary", shards)

    def counts(self, shards: list[int] | None = None) -> DataFrame:
        """shard, k1, k2, n_docs, last_doc of what is in the index now."""
        return self.refs(shards).groupBy("shard", "k1", "k2").agg(F.sum("copies").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def _touched(self, posted: DataFrame) -> list[int]:
        """The shards of the postings: at most as many as there are."""
        shards = sorted(r["shard"] for r in posted.select("shard").distinct().collect())
        self.rows_read = sum(self.at[s][1] for s in shards if s in self.at)
        return shards

    def _commit(self, refs: DataFrame, version: int, at: dict[int, tuple[int, int]]) -> None:
        """Writes refs, each shard by a few tasks, and adds the shards' sizes to at."""
        refs.repartition("shard", F.pmod(F.xxhash64("row"), F.lit(4))).write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/refs-{version}")
        made = self.spark.read.schema("shard int, k1 long").parquet(f"{self.folder}/refs-{version}")
        at.update({r["shard"]: (version, r["n"]) for r in made.groupBy("shard").agg(F.count("*").alias("n")).collect()})

    def _change(self, docs: DataFrame, sign: int) -> LineIndex:
        n, key = self.version + 1, ["shard", "k1", "k2"]
        posted = checkpointed(sharded(postings(docs), self.shards).groupBy(*key, "doc_id", "row").agg((F.count("*") * sign).alias("copies")))
        shards = self._touched(posted)
        old = self.refs(shards)
        merged = old.unionByName(posted).groupBy(*key, "doc_id", "row").agg(F.sum("copies").alias("copies")).where("copies > 0")
        at = {s: v for s, v in self.at.items() if s not in set(shards)}
        self._commit(merged, n, at)
        now = self.spark.read.schema(old.schema).parquet(f"{self.folder}/refs-{n}")
        sides = old.select(*key, F.col("copies").alias("was"), F.lit(0).cast("long").alias("now")).unionByName(now.select(*key, F.lit(0).cast("long").alias("was"), F.col("copies").alias("now")))
        per = sides.join(posted.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
        comes = F.col("now") >= self.least_docs
        turns = per.where((F.col("was") >= self.least_docs) != comes).select("shard", "k1", comes.alias("comes"))
        new = checkpointed(self.filters(shards).groupBy("shard").cogroup(turns.groupBy("shard")).applyInPandas(_updated, "shard int, filter binary"))
        full = [r["shard"] for r in new.where("filter is null").select("shard").collect()]
        if full:
            again = now.where(F.col("shard").isin(full)).groupBy(*key).agg(F.sum("copies").alias("n_docs"))
            new = new.where("filter is not null").unionByName(filters(again, self.least_docs))
        new.write.mode("overwrite").parquet(f"{self.folder}/filters-{n}")
        self._publish(n, at, self.shards)
        total = sum(size for _, size in self.at.values())
        if total > 2 * SHARD_POSTINGS * self.shards:
            self._grow(total)
        return self

    def _publish(self, version: int, at: dict[int, tuple[int, int]], shards: int) -> None:
        rows = [(shards, s, v, size) for s, (v, size) in at.items()] or [(shards, None, None, None)]
        self.spark.createDataFrame(rows, "shards int, shard int, version int, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest-{version}")
        self.version, self.at, self.shards = version, at, shards

    def _grow(self, total: int) -> None:
        n, shards = self.version + 1, self.shards
        while total > SHARD_POSTINGS * shards:
            shards *= 2
        at: dict[int, tuple[int, int]] = {}
        self._commit(sharded(self.refs().drop("shard"), shards), n, at)
        now = self.spark.read.schema("shard int, k1 long, k2 long, copies long").parquet(f"{self.folder}/refs-{n}")
        filters(now.groupBy("shard", "k1", "k2").agg(F.sum("copies").alias("n_docs")), self.least_docs).write.mode("overwrite").parquet(f"{self.folder}/filters-{n}")
        self._publish(n, at, shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs: the documents as they were inserted (id and text)."""
        return self._change(docs, -1)

    def apply(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """docs without the lines that the index holds to be repeated; see dedup_lines."""
        posted = checkpointed(sharded(postings(docs), self.shards))
        shards = self._touched(posted)
        return without(docs, decisions(posted, self.counts(shards), self.filters(shards), posted.count(), self.least_docs, self.shards), keep)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


ORACLE = r"""
WITH lines AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT k, MAX(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING COUNT(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, i, line, h.k IS NOT NULL AND l.doc_id <> h.last_doc AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
        sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

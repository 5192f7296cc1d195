"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-grams.

A text is rejected if it is too far from its nearest centroid for a text of its length, or lies about
as near to a second language. Both limits are calibrated on the fitted rows, each left out of its own
centroid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.common import checkpointed, row_hash

SIZE_BITS = 14  # hashed character bigrams and trigrams
FIT_ROWS = 600  # of a language, at most about so many distinct labelled rows fit the model, drawn by hash
CENTROIDS = 3
KEEP = 0.8  # a text is rejected if its cosine is below KEEP x that of all but 1 % of fitted rows of its length
TIE = 0.8  # or if its distance to the nearest language is over TIE (or that of 99 % of fitted rows, if more) x that to the second
_STEPS = 2 * SIZE_BITS + 1  # lengths by half octaves of distinct n-grams
_CHUNK = 1 << 20
_CELLS = 1 << 24  # of the centroids, at once for a text
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([i if chr(i).isalpha() else 0 for i in range(0x10000)], np.uint64)
    return _letters


def _codes(part: str) -> np.ndarray:
    """Code points of letters, each run of anything else as one 0."""
    raw = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letter_table()[np.minimum(raw, 0xFFFF)]
    if raw.size and raw.max() > 0xFFFF:
        high = np.unique(raw[raw > 0xFFFF])
        codes[np.isin(raw, high[[chr(c).isalpha() for c in high]])] = 0xFFFF
    both = np.zeros(codes.size + 2, np.uint64)
    both[1:-1] = codes
    keep = np.ones(both.size, bool)
    keep[1:] = (both[1:] != 0) | (both[:-1] != 0)
    return both[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's letter n-grams and their weights 1 + ln(count); empty without letters."""
    counts = np.zeros(1 << SIZE_BITS, np.int64)
    seen, shift = False, np.uint64(64 - SIZE_BITS)
    for at in range(0, len(text or ""), _CHUNK):
        c = _codes(text[at : at + _CHUNK])
        if c.any():
            seen = True
            two = c[:-1] * _A + c[1:] * _B
            three = two[:-1] * _B + c[2:] * _C
            for h in (two, three):
                counts += np.bincount((((h ^ (h >> np.uint64(29))) * _A) >> shift).astype(np.int64), minlength=counts.size)
    ids = np.nonzero(counts)[0] if seen else np.empty(0, np.int64)
    return ids, (1 + np.log(counts[ids])).astype(np.float32)


def _step(n: np.ndarray | int) -> np.ndarray:
    return np.minimum(2 * np.log2(np.maximum(n, 1)), _STEPS - 1).astype(int)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # bucket
    centroids: np.ndarray  # bucket, centroid; unit columns
    owner: np.ndarray  # centroid: language; ascending
    floor: np.ndarray  # centroid, length step: least cosine that is not rejected
    tie: np.ndarray  # length step: greatest ratio of the distances to the nearest and the second language

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is near enough to the centroid, and nearer than to others, to be accepted."""
        ids, w = grams(text)
        if not ids.size or not self.languages:
            return "und", 0.0, False
        w = w * self.idf[ids]
        step = max(1, _CELLS // self.owner.size)
        cos = sum(w[i : i + step] @ self.centroids[ids[i : i + step]] for i in range(0, ids.size, step)) / np.sqrt((w * w).sum())
        best = int(cos.argmax())
        other = cos[self.owner != self.owner[best]].max(initial=-1.0)
        at = int(_step(ids.size))
        near = cos[best] >= self.floor[best, at] and 1 - cos[best] <= self.tie[at] * (1 - other)
        return self.languages[self.owner[best]], float(min(1.0, max(0.0, cos[best]))), bool(near)


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from spread-out rows; unit rows."""
    picks = [0]
    for _ in range(1, min(k, len(x))):
        picks.append(int((x @ x[picks].T).max(axis=1).argmin()))
    c = x[picks].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                mean = x[near == j].mean(axis=0)
                c[j] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    return c


def training(docs: DataFrame, eligible: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """At most about fit_rows distinct labelled rows of every language, by a hash of id and text: key, text, lang."""
    rows = docs.where(eligible & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # a row a language
    schema = StructType([StructField("lang", rows.schema["lang"].dataType), StructField("share", DoubleType())])
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, fit_rows / r["count"])) for r in counts], schema)
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.select(row_hash("doc_id", "text").alias("key"), "text", "lang", draw.alias("draw")).join(F.broadcast(shares), "lang")
    return rows.where("draw < share").select("key", "text", "lang").dropDuplicates(["key", "lang"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(lang, key, *grams(text)) for key, text, lang in zip(*[c.to_pylist() for c in b.columns])]
        rows = [(lang, key, ids.astype("<u2").tobytes(), w.astype("<f4").tobytes()) for lang, key, ids, w in rows if ids.size]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), *[pa.binary()] * 3))], ["lang", "key", "ids", "w"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket how many texts have it; at -1 all texts."""
    for b in batches:
        n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=1 << SIZE_BITS)
        has = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, has], pa.int32()), pa.array(np.r_[b.num_rows, n[has]], pa.int64())], ["bucket", "n"])


def _rows_of(group: pd.DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows in order of key, and how many n-grams each has."""
    group = group.sort_values("key")
    x, n = np.zeros((len(group), idf.size), np.float32), np.zeros(len(group), int)
    for i, (ids, w) in enumerate(zip(group["ids"], group["w"])):
        at = np.frombuffer(ids, "<u2")
        x[i, at] = np.frombuffer(w, "<f4") * idf[at]
        x[i] /= np.sqrt((x[i] * x[i]).sum())
        n[i] = at.size
    return x, n


def _fitted(idf: np.ndarray, k: int) -> Callable:
    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        c = _clusters(_rows_of(group, idf)[0], k)
        return pd.DataFrame({"lang": [key[0]] * len(c), "no": range(len(c)), "centroid": [v.astype("<f4").tobytes() for v in c]})

    return one


def _left_out(shared) -> Callable:
    """For the rows of one language: nearest centroid, cosine to the nearest as it were without the row
    (NaN if there were none), cosine to the nearest of another language, number of n-grams."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        model = shared.value
        x, n = _rows_of(group, model.idf)
        cos = x @ model.centroids
        mine = model.owner == model.languages.index(key[0])
        own = cos[:, mine]
        near = own.argmax(axis=1)
        left = np.full(own.shape, np.nan, np.float32)
        for j in range(own.shape[1]):
            total, member = x[near == j].sum(axis=0), near == j
            size, product = float(total @ total), x @ total
            rest = np.sqrt(np.maximum(size - np.where(member, 2 * product - 1, 0), 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                left[:, j] = np.where(rest > 1e-3, (product - member) / rest, np.nan)
        best = np.where(np.isnan(left).all(axis=1), np.nan, np.nan_to_num(left, nan=-1).max(axis=1))
        other = cos[:, ~mine].max(axis=1, initial=-1)
        return pd.DataFrame({"centroid": np.flatnonzero(mine)[near], "own": best.astype(float), "other": other.astype(float), "n": n})

    return one


def _by_length(step: np.ndarray, value: np.ndarray, q: float, least: int = 20) -> np.ndarray:
    """A quantile for each length step, over the step and as many around it as hold enough rows."""
    out = np.empty(_STEPS)
    for s in range(_STEPS):
        for around in range(_STEPS):
            near = np.abs(step - s) <= around
            if near.sum() >= min(least, step.size):
                break
        out[s] = np.quantile(value[near], q)
    return out


def _calibrated(model: Model, rows: pd.DataFrame) -> Model:
    rows = rows[rows["own"].notna()]
    if len(rows):
        step, own = _step(rows["n"].to_numpy()), rows["own"].to_numpy()
        low = _by_length(step, own, 0.01)
        share = own / np.maximum(low[step], 1e-6)
        for c in range(model.owner.size):
            mine = share[(rows["centroid"] == c).to_numpy()]
            model.floor[c] = KEEP * low * (min(1.0, float(np.quantile(mine, 0.01))) if mine.size else 1.0)
        if len(model.languages) > 1:
            far = (1 - own) / np.maximum(1 - rows["other"].to_numpy(), 1e-6)
            model.tie = np.maximum(TIE, _by_length(step, far, 0.99))
    return model


def fit(sample: DataFrame, centroids: int = CENTROIDS) -> Model:
    """The model of a bounded sample (see training) of key, text and lang.

    Each language is fitted on an executor, its rows in order of key, so that neither partitions nor
    reruns matter. To the driver come the centroids, 64 kB each, and four numbers a row. Where no row
    can be left out (languages of one row) nothing is rejected by distance; without rows all are und.
    """
    v = checkpointed(sample.select("key", "text", "lang").mapInArrow(_vectors, "lang string, key binary, ids binary, w binary"))
    df = np.zeros(1 << SIZE_BITS, np.int64)
    total = 0
    for r in v.select("ids").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    if not total:
        return Model([], idf, np.zeros((idf.size, 0), np.float32), np.zeros(0, int), np.zeros((0, _STEPS)), np.ones(_STEPS))
    got = sorted(v.groupBy("lang").applyInPandas(_fitted(idf, centroids), "lang string, no int, centroid binary").collect())
    names = sorted({r["lang"] for r in got})
    both = np.stack([np.frombuffer(r["centroid"], "<f4") for r in got], axis=1)
    model = Model(names, idf, both, np.array([names.index(r["lang"]) for r in got]), np.zeros((len(got), _STEPS)), np.full(_STEPS, np.inf))
    shared = v.sparkSession.sparkContext.broadcast(model)
    rows = v.groupBy("lang").applyInPandas(_left_out(shared), "centroid long, own double, other double, n long").toPandas()
    return _calibrated(model, rows)


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """keep (columns of docs), then lang_pred string, score double, accepted boolean, under the given names.

    Null text or one without letters: und, 0, false. Empty input: no rows; rows are independent,
    so repeated ones agree. Of ties the first centroid wins, languages in order. lang, if there is
    such a column, is not read.
    """
    # CENTROIDS x 64 kB a language.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index("text") if "text" in keep else len(keep)
    cols = keep if "text" in keep else [*keep, "text"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [shared.value.classify(t) for t in b.column(at).to_pylist()]
            out = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *out], [*keep, *names])

    return docs.select(*cols).mapInArrow(batches, f"{types}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4

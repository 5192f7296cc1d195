"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base kinds are exact patterns and always reported. Further candidates (secrets, phone numbers
without +, id numbers, veiled e-mail addresses, names) each get the votes of a pattern, a gazetteer
and a context labeler. Votes and features take few values, so counts over all documents fit EM and
the classifier without loss.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "local_phone", "id_number", "veiled_email", "name")
KINDS = (*BASE, *MORE)
LABELERS = ("pattern", "gazetteer", "context")
WEAK = {("secret", "pattern"), ("id_number", "gazetteer")}  # labelers that often vote for what is not real
PRIOR_ROWS = 10
SURE = 0.8  # probability from which the classifier reports a span
NEAR = 30  # code points before a span that are its context
_SOME = re.compile(r"[0-9@+]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match starts and ends with whole runs of digits, so looking behind changes nothing but keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FIND = {
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/.-]{16})[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+={0,2}"),
    "local_phone": re.compile(r"(?<![0-9+().-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "id_number": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "veiled_email": re.compile(r"[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++", re.I),
    "name": regex.compile(r"(?<!\p{L})(?!(?:Dear|Contact|Signed|Mr|Mrs|Ms|Dr)\b)\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)? \p{Lu}\p{Ll}++(?!\p{L})"),
}
_VEIL = re.compile(r"[\[(]at[\])]", re.I)
_DIGIT = re.compile("[0-9]")
_HEX = re.compile("(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_RUNS = re.compile("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")
_WORD = "(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4})"
_WORDY = re.compile(f"[-_/.+]*{_WORD}(?:[-_/.+]+{_WORD})+[-_/.+]*")
#: Common first names in English, German, French and Spanish.
FIRST_NAMES = (
    "Adam Alain Alejandro Alexander Alice Amy Ana Andrea Andreas Andrew Angela Anna Anne Antonio Barbara Benjamin Bernd Brian Camille Carlos Carmen Carol Catherine Charles Christian Christine Christopher "
    "Claudia Daniel David Deborah Diego Dieter Donald Edward Elena Elizabeth Emily Emma Eric Fernando Francisco François Frank Franz George Gerhard Hannah Hans Heike Helen Helmut Isabel Isabelle Jacques James Jan "
    "Javier Jean Jennifer Jessica Joachim John José Joseph Joshua Juan Julia Julie Jürgen Karen Karin Karl Kathleen Katrin Kenneth Kevin Klaus Laura Laurent Linda Lisa Louis Luis Manuel Margaret María Maria Marie Mark Markus "
    "Martin Martina Mary Matthew Melissa Michael Michel Miguel Monika Nancy Nathalie Nicholas Nicole Olivier Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Rebecca Richard Robert Ronald Rosa Ruth Sabine "
    "Sandra Sarah Sergio Sofía Sophie Stefan Stephen Steven Susan Susanne Sylvie Thomas Timothy Ursula Victoria Walter William Wolfgang"
)
_GAZETTEER = {
    "email": re.compile(r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", re.I),
    "veiled_email": re.compile(r"(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", re.I),
    "ip": re.compile(r"^(?!0|127\.|255)"),
    "card": re.compile(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
    "phone": re.compile(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"),
    "local_phone": re.compile(r"555"),
    "id_number": re.compile(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    "secret": re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xox[bp]-|AIza|glpat-)"),
    "name": re.compile(rf"^(?:{FIRST_NAMES.replace(' ', '|')})[ -]"),
}
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|address|correo|courriel", re.I),
    "veiled_email": re.compile(r"e-?mail|contact|write to|address|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|master|payment|credit|tarjeta|karte|carte", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|m[oó]vil|telefon", re.I),
    "local_phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|m[oó]vil|telefon", re.I),
    "id_number": re.compile(r"ssn|social security|id number|ausweis|dni\b", re.I),
    "secret": re.compile(r"(?:passw(?:or)?d|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s*[:=]\s*[\"']?$", re.I),
    "name": re.compile(r"(?:name is|name:|dear|contact:?|mr\.?|mrs\.?|ms\.?|dr\.?|signed,?)\s*$", re.I),
}


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, in code points, by start and then kind as listed."""
    if not _SOME.search(text):
        return []
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=_place)


def _place(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def _pattern(kind: str, s: str) -> int:
    """Does the candidate have the full form of its kind? -1 against, 0 unsure, 1 for."""
    if kind in BASE or kind == "veiled_email":
        return 1
    if kind == "id_number":
        return 0
    if kind == "secret":
        if s.isdigit() or _WORDY.fullmatch(s) or _UUID.fullmatch(s):
            return -1
        if _HEX.fullmatch(s):
            return 0  # a hash as well as a key
        runs = len(_RUNS.findall(s)) / len(s)  # random characters change class often, words do not
        mixed = (s != s.lower() and s != s.upper()) + bool(_DIGIT.search(s)) + (len(set(s)) >= 12)
        return 1 if mixed == 3 and runs >= 0.25 else 1 if mixed >= 2 and runs >= 0.35 else 0
    return 1 if kind == "local_phone" else 0


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, int, int]:
    s, before = text[start:end], text[max(0, start - NEAR) : start]
    listed = _GAZETTEER[kind].search(s)
    return _pattern(kind, s), 1 if listed else (-1 if kind in ("name", "id_number") else 0), 1 if _CONTEXT[kind].search(before) else 0


def features(text: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Length, share of digits, variety, and whether a sign that binds a value comes before."""
    s = text[start:end]
    return min(len(s) // 8, 5), sum(c.isdigit() for c in s) * 4 // len(s), min(len(set(s)) // 4, 5), int(text[max(0, start - 1) : start] in ("=", '"', "'", ":", "("))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the further kinds that overlap no base span and, being of one kind, not each other.

    base: sorted by start. No pattern has an upper length, and all take time in proportion to the text.
    """
    out = []
    starts, ends = [a for _, a, _ in base], list(accumulate((b for *_, b in base), max))
    digits, veiled = _DIGIT.search(text), _VEIL.search(text)
    for kind, find in _FIND.items():
        if kind == "veiled_email" and not veiled or kind in ("local_phone", "id_number", "secret") and not digits:
            continue
        done = 0
        for m in find.finditer(text):
            start, end = m.span()
            if kind == "secret" and (end - start < 16 or not _DIGIT.search(m[0])):
                continue
            if kind == "veiled_email":
                start = stop = start - (text[start - 1 : start] == " ")
                while start > done and text[start - 1] in _LOCAL:
                    start -= 1
                while start < stop and text[start] == ".":
                    start += 1
                if start >= stop:
                    continue
                done = end
            before = bisect_left(starts, end)  # base spans that start before the candidate ends
            if not before or ends[before - 1] <= start:
                out.append((kind, start, end))
    return out


@dataclass
class Model:
    prior: dict[str, float]
    reliability: dict[tuple[str, int], np.ndarray]  # kind, labeler: P(vote | class) by class and vote + 1
    weights: np.ndarray

    def posterior(self, kind: str, vote: tuple[int, ...]) -> float:
        """The label model's probability that a candidate with these votes is real."""
        p = np.array([1 - self.prior[kind], self.prior[kind]])
        for j, v in enumerate(vote):
            p = p * self.reliability[kind, j][:, v + 1]
        return float(p[1] / p.sum())

    def probability(self, kind: str, vote: tuple[int, ...], feature: tuple[int, ...]) -> float:
        """The span classifier's."""
        return float(1 / (1 + np.exp(-(_design(kind, vote, feature) @ self.weights))))


_SIZE = 1 + 10 * len(KINDS) + 18


def _design(kind: str, vote: tuple[int, ...], feature: tuple[int, ...] | None) -> np.ndarray:
    """Kind, votes by kind, and features, each value a column; no features: of the average span."""
    x = np.zeros(_SIZE)
    at = 1 + 10 * KINDS.index(kind)
    x[0] = x[at] = 1
    for j, v in enumerate(vote):
        x[at + 1 + 3 * j + v + 1] = 1
    at = 1 + 10 * len(KINDS)
    for value, size in zip(feature or (), (6, 5, 6, 1)):
        if size > 1:
            x[at + value] = 1
        else:
            x[at] = value
        at += size
    return x


def fit(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 50) -> Model:
    """From (kind, votes, features, count) over all candidates. Few or no patterns leave the priors.

    EM begins at, and keeps as two thirds of its evidence, what is assumed of a labeler: a vote for is rare
    on what is not real (2 %), less so of the labelers in WEAK (15 %). The span classifier is fitted
    to all counts and, so that votes that are not in the data count as the label model has them, to
    PRIOR_ROWS rows of every kind and votes.
    """
    start = {
        (k, j): np.array([[0.25, 0.6, 0.15] if (k, name) in WEAK else [0.28, 0.7, 0.02], [0.02, 0.38, 0.6]]) for k in KINDS for j, name in enumerate(LABELERS)
    }
    model = Model({k: 0.9 if k in BASE else 0.5 for k in KINDS}, {k: v.copy() for k, v in start.items()}, np.zeros(_SIZE))
    seen: Counter = Counter()
    for kind, vote, _, n in patterns:
        seen[kind, vote] += n
    for _ in range(rounds):
        for kind in {k for k, _ in seen}:
            rows = [(v, n, model.posterior(kind, v)) for (k, v), n in seen.items() if k == kind]
            total = sum(n for _, n, _ in rows)
            soft = 20 + 2 * total  # prior rows keep the classes from swapping
            model.prior[kind] = (sum(n * p for _, n, p in rows) + soft / 2 * (0.9 if kind in BASE else 0.5)) / (total + soft / 2)
            for j in range(3):
                c = soft * start[kind, j]
                for v, n, p in rows:
                    c[:, v[j] + 1] += n * np.array([1 - p, p])
                model.reliability[kind, j] = c / c.sum(axis=1, keepdims=True)
    rows = [*patterns, *[(k, v, None, PRIOR_ROWS) for k in KINDS for v in product((-1, 0, 1), repeat=3)]]
    x = np.array([_design(k, v, f) for k, v, f, _ in rows])
    y = np.array([model.posterior(k, v) for k, v, _, _ in rows])
    n = np.array([c for *_, c in rows], float)
    w = model.weights
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (n * (y - p)) - 0.05 * w)
    model.weights = w
    return model


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: Counter = Counter()
        for text in b.column(0).to_pylist():
            if text:
                base = base_spans(text)
                for kind, s, e in base + candidates(text, base):
                    seen[kind, votes(kind, text, s, e), features(text, s, e)] += 1
        rows = [(k, *v, *f, n) for (k, v, f), n in seen.items()]
        cols = list(zip(*rows)) if rows else [[]] * 9
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:8]], pa.array(cols[8], pa.int64())], ["kind", *"abcdefg", "n"])


def train(docs: DataFrame) -> Model:
    """Fitted to all candidates in text: what comes to the driver are counts of distinct patterns."""
    schema = "kind string, a int, b int, c int, d int, e int, f int, g int, n long"
    got = docs.select("text").mapInArrow(_patterns, schema).groupBy("kind", *"abcdefg").agg(F.sum("n").alias("n")).collect()
    return fit(sorted((r[0], (r[1], r[2], r[3]), tuple(r[4:8]), r[8]) for r in got))


def spans(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: those and the candidates of which the classifier is sure."""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    for kind, s, e in candidates(text, base):
        v = votes(kind, text, s, e)
        if model.probability(kind, v, features(text, s, e)) >= SURE:
            more.append((kind, s, e))
    return base, sorted(base + more, key=_place)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans (kind:start:end, comma-joined).

    Positions are code points, end exclusive. Null or empty text: no spans, empty strings. A span of
    the further kinds never overlaps a base one. Rows are independent; repeated ones agree. Empty
    input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [spans(t, shared.value) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in g[0]) for g in got], pa.int64()) for k in BASE]
            texts = [pa.array([joined(g[i]) for g in got], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *texts], ["doc_id", *[f"n_{k}" for k in BASE], "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

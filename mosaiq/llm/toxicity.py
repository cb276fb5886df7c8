"""Toxicity as ordinal severity: cumulative-link (proportional odds) regression over sparse word features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all grades and ordered thresholds; the severity of a
text is the expected grade, the sum of these over k = 1, 2, 3.

Labels are yes or no, so grades are made for training from how much of a text is toxic: 0 for no; yes is divided in thirds by
the number of the text's sentences that hold a marked word. A word is marked for one half of the labelled documents (by a
hash of the id) if it is far more frequent in the toxic texts of the other half. So no text takes part in marking the words
that grade it, and the grade counts sentences, which the model, a sum over the words of the whole text, doesn't see.

The fit uses at most MAX_DOCS labelled documents, the least by a hash of the id (and of 2 * MAX_DOCS rows or more, which
only repeated ids can make, the least by a hash), and FEATURES words, those most associated with the label: fixed,
documented bounds. Scoring takes whole texts.

Defined cases: null and empty texts have no words and severity of the thresholds alone; without labelled rows of both
kinds every severity is 0; null ids are carried; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, picked, prepare, written

MAX_DOCS, FEATURES, GRADES, MIN_SUPPORT = 4000, 300, 3, 5
#: A word is marked if it is this many times more frequent among toxic texts.
MARKED_RATIO = 20.0
WORD, SENTENCE_END = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n]+")
#: Lengths of the word beginnings that are features beside the words.
PREFIXES = (5, 6, 7)


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def parts(word: str) -> list[str]:
    """The word and its beginnings, which are marked."""
    return [word, *(f"{word[:k]}^" for k in PREFIXES if len(word) >= k)]


class Features:
    """Places and values of a text's known features, and its number of words."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.memo: dict[str, tuple[int, ...]] = {}

    def _known(self, word: str) -> tuple[int, ...]:
        return tuple(self.words[p] for p in parts(word) if p in self.words)

    def __call__(self, text: str | None) -> tuple[list[int], list[float], int]:
        all_words, memo = WORD.findall((text or "").lower()), self.memo
        if len(memo) > 300_000:
            memo.clear()
        seen: Counter = Counter()
        for w in all_words:
            got = memo.get(w)
            if got is None:
                got = self._known(w)
                if len(w) <= 48:
                    memo[w] = got
            if got:
                seen.update(got)
        n = len(all_words)
        return list(seen), [float(np.log1p(c) + np.log1p(100 * c / n)) for c in seen.values()], n


def at_least(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Probability of each grade or more; zero where the threshold is infinite."""
    p = 1 / (1 + np.exp(-np.clip(score[:, None] - np.where(np.isinf(thresholds), 0, thresholds)[None, :], -40, 40)))
    return np.where(np.isinf(thresholds)[None, :], 0.0, p)


def thresholds_of(first: float, steps: np.ndarray) -> np.ndarray:
    return first + np.r_[0, np.cumsum(np.exp(steps))]


def objective(point: np.ndarray, x: np.ndarray, grade: np.ndarray, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Mean log-likelihood with a ridge, and its gradient. point: the weights, the first threshold, and the logarithms of the
    steps from one threshold to the next."""
    n, d = x.shape
    w, steps, rows = point[:d], point[d + 1 :], np.arange(n)
    s = np.c_[np.ones(n), at_least(x @ w, thresholds_of(point[d], steps)), np.zeros(n)]
    slope = s * (1 - s)
    p = np.maximum(s[rows, grade] - s[rows, grade + 1], 1e-9)
    up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p
    g_theta = np.array([(down[grade == k - 1].sum() - up[grade == k].sum()) for k in range(1, GRADES + 1)]) / n
    g_steps = np.array([g_theta[k:].sum() for k in range(1, GRADES)]) * np.exp(steps)
    value = float(np.log(p).mean() - ridge * (w @ w) / 2 - 1e-3 * (steps @ steps) / 2)
    return value, np.r_[x.T @ (up - down) / n - ridge * w, g_theta.sum(), g_steps - 1e-3 * steps]


def fit(x: np.ndarray, grade: np.ndarray, rounds: int = 400, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum likelihood with a ridge, by Adam with a rate that falls to zero."""
    d = x.shape[1]
    point = np.r_[np.zeros(d), 1.0, np.zeros(GRADES - 1)]
    m, v = np.zeros(len(point)), np.zeros(len(point))
    for i in range(1, rounds + 1):
        _, g = objective(point, x, grade, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        point = point + rate * (1 - (i - 1) / rounds) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        point[d + 1 :] = np.clip(point[d + 1 :], -5, 5)
    return point[:d], thresholds_of(point[d], point[d + 1 :])


def extent(text: str | None, marked: frozenset[str]) -> int:
    """Sentences that hold a marked word."""
    return sum(not marked.isdisjoint(WORD.findall(x)) for x in SENTENCE_END.split((text or "").lower()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """From labelled documents whose crc32 of the id leaves a remainder by 5."""
    prepare(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    some = labels.where((F.crc32(key.cast("string")) % 5 != 0) & F.col(f"`{label_col}`").isin(0, 1)).orderBy(F.xxhash64(key), key).select(key.alias("_key"), F.col(f"`{label_col}`").cast("int").alias("_label")).limit(max_docs)
    src = picked(docs, id_col, text_col)
    half = F.pmod(F.xxhash64(F.col("_id")), F.lit(2)).cast("int")
    rows = src.join(F.broadcast(some), F.col("_id") == F.col("_key")).select("_label", "_text", half.alias("_half"))  # max_docs rows at most are broadcast

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((y, h, w) for y, t, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in {None, *(p for x in set(WORD.findall((t or "").lower())) for p in parts(x))})
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)), pa.array([k[2] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["y", "h", "w", "n"])

    def ratio(toxic: Column, clean: Column, of: tuple[int, int]) -> Column:
        return F.log((toxic + 0.5) / (of[1] + 1)) - F.log((clean + 0.5) / (of[0] + 1))

    cells = [(y, h) for y in (0, 1) for h in (0, 1)]
    by = rows.mapInArrow(distinct, "y int, h int, w string, n long").groupBy("w").agg(*(F.sum(F.when((F.col("y") == y) & (F.col("h") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y, h in cells))
    by = written(by, "words")  # of the sample's texts; read four times
    totals = by.where("w is null").first()
    of = [tuple(totals[f"n{y}{h}"] for y in (0, 1)) for h in (0, 1)] if totals else [(0, 0)] * 2
    both = (of[0][0] + of[1][0], of[0][1] + of[1][1])
    if not all(both):
        return Model({}, np.zeros(0), np.full(GRADES, np.inf))
    n0, n1 = (F.col(f"n{y}0") + F.col(f"n{y}1") for y in (0, 1))
    known = by.where(F.col("w").isNotNull())
    best = known.where(n0 + n1 >= MIN_SUPPORT).select("w", (F.abs(ratio(n1, n0, both)) * F.sqrt(n0 + n1)).alias("z")).orderBy(F.desc("z"), "w").limit(FEATURES).collect()
    words = {r["w"]: k for k, r in enumerate(best)}
    marked = []
    for h in (1, 0):  # of half 0, then 1: what marks is the other half
        toxic, clean = F.col(f"n1{h}"), F.col(f"n0{h}")
        strong = known.where((toxic + clean >= MIN_SUPPORT) & ~F.col("w").endswith("^")).select("w", ratio(toxic, clean, of[h]).alias("r")).where(F.col("r") > float(np.log(MARKED_RATIO)))
        marked.append(frozenset(r["w"] for r in strong.orderBy(F.desc("r"), "w").limit(FEATURES).collect()))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Features(words)
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [read(t) for t in texts]
            hits = [extent(t, marked[h]) for t, h in zip(texts, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array(hits, pa.int64())], names=["y", "at", "x", "hits"])

    sample = rows.mapInArrow(vectors, "y int, at array<int>, x array<double>, hits long").orderBy(F.xxhash64("y", "hits", "at", "x"), "y", "hits", "at", "x").limit(2 * max_docs).toPandas()
    x = np.zeros((len(sample), len(words)))
    for k, (at, v) in enumerate(zip(sample["at"], sample["x"], strict=True)):
        x[k, np.asarray(at, int)] = v
    y, hits = sample["y"].to_numpy(), sample["hits"].to_numpy()
    toxic = np.sort(hits[y == 1])
    rank = (np.searchsorted(toxic, hits, "left") + np.searchsorted(toxic, hits, "right")) / (2 * len(toxic))  # that of equal ones' middle
    w, theta = fit(x, np.where(y == 1, 1 + np.minimum(GRADES * rank, GRADES - 1).astype(int), 0))
    return Model(words, w, theta)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (expected grade, 0 to 3), p_toxic (of grade 1 or more), grade (the number of thresholds passed) and toxic."""
    prepare(docs.sparkSession)
    src = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Features(model.words)
        for b in batches:
            if b.num_rows:
                got = [read(t) for t in b.column(1).to_pylist()]
                p = at_least(np.array([float(np.dot(model.weights[at], v)) if at else 0.0 for at, v, _ in got]), model.thresholds)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], names=["_id", "severity", "p_toxic", "grade", "toxic"])

    return src.mapInArrow(run, f"_id {id_type(src)}, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("_id", id_col)

"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before and after it; the chain's weights
couple neighbouring labels. Forward-backward gives each line's probability of being good, and a document's score is
their mean weighted by line length in bytes.

Labels are of documents, so those of lines are inferred while the model is fitted. At first every line has its document's
label and only a line's own features count, else lines would learn to be as their neighbours are; then, by turns, the chain's own posterior under a constraint is taken for the lines' labels and the weights are
fitted to it. The constraint is on the length-weighted share of good lines that is expected of a chain: BAD_SHARE at most
if its document is bad, GOOD_SHARE at least if it is good. Of all distributions that keep to it the one nearest to the
posterior is the posterior with a bias on the lines, which is found by bisection. So a bad document's plain lines may be
good and the transitions learn from unlike neighbours.

The fit uses at most MAX_DOCS labelled documents (the least by a hash of the id) and all their lines, in chains of
MAX_LINES lines at most. If they hold over MAX_DOCS * MAX_LINES lines together, a share of the chains is taken by a hash
of id and place; and of more than 3 * MAX_DOCS chains, which only rows that repeat an id can make, the least by a hash. These
are fixed, documented bounds, so the driver holds the same amount whatever the input, and no part of a text is left out
for where it stands. Scoring takes whole texts.

Scores read the text alone: no label, language, source or id.

Defined cases: a null or empty text is one empty line, whose score is the model's; without any labelled row all weights
are zero and every score is 0.5; null ids are carried and not held out; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored by the score and kept by keep_good. Documents are scored in
blocks of like length, so memory follows a batch's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, picked, prepare

MAX_DOCS, MAX_LINES = 3000, 200
THRESHOLD = 0.3
#: Of the good lines: the most that is expected of a bad document, and the least of a good one.
BAD_SHARE, GOOD_SHARE = 0.2, 0.9
FEATURES = ("bytes", "words", "word_length", "upper", "symbols", "digits", "bars", "bangs", "marks", "other_bytes", "ends_sentence", "empty", "repeated", "same_words")
_NEAR = (3, 4, 6, 7, 12, 13)
WIDTH = len(FEATURES) + 2 * len(_NEAR) + 1


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _LOWER, _DIGIT = (_table(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_SPACE, _SYMBOL, _MARK, _HIGH = (_table(x) for x in (b" \t\n\x0b\x0c\r", b"#*$%&<>@^_=+~\\/", b".,;:?!\"'()-", bytes(range(128, 256))))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its weight, and each text's number of lines."""
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.r_[0, ends[:-1] + 1]
    counts = np.array([t.count(b"\n") + 1 for t in texts])

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64).astype(np.float64)

    space = _SPACE[a]
    word = ~space
    word[1:] &= space[:-1]
    size = (ends - starts).astype(np.float64)
    words, upper, high = total(word), total(_UPPER[a]), total(_HIGH[a])
    letters = upper + total(_LOWER[a]) + high
    inside = np.maximum(size + 1 - total(space), 0)
    per = np.maximum(words, 1)
    doc = np.repeat(np.arange(len(texts)), counts)
    seen: set = set()
    repeated, same = np.zeros(len(starts)), np.zeros(len(starts))
    for k, (d, s, e) in enumerate(zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        if e > s:
            key = (d, data[s:e])
            repeated[k] = key in seen
            seen.add(key)
            w = key[1].split()
            if w:
                same[k] = 1 - len(set(w)) / len(w)
    x = np.empty((len(starts), WIDTH))
    last = a[np.maximum(ends - 1, 0)]
    x[:, : len(FEATURES)] = np.c_[
        np.log1p(size), np.log1p(words), inside / per / 10, upper / np.maximum(letters, 1), np.minimum(total(_SYMBOL[a]) / per, 4), total(_DIGIT[a]) / np.maximum(inside, 1), np.minimum(total(a == 124) / per, 2),
        np.minimum(total(a == 33) / per, 3), np.minimum(total(_MARK[a]) / per, 4), high / np.maximum(inside, 1), (last == 46) & (size > 0), size == 0, repeated, same,
    ]
    first = np.r_[True, doc[1:] != doc[:-1]]
    near = x[:, _NEAR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[first], after[np.r_[first[1:], True]] = 0, 0
    n = len(FEATURES)
    x[:, n : n + len(_NEAR)], x[:, n + len(_NEAR) : -1], x[:, -1] = before, after, 1
    return x, size + 1, counts


@dataclass(frozen=True)
class Model:
    """weights: of a good line over a bad one. step[a, b]: of label b after label a."""

    weights: np.ndarray
    step: np.ndarray


def blank() -> Model:
    return Model(np.zeros(WIDTH), np.zeros((2, 2)))


def _padded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), int(counts.max())))
    out[np.arange(out.shape[1]) < counts[:, None]] = values
    return out


def forward_backward(gain: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains with the gains (chain, position): the probability of good at each position, and the expected number of
    each pair of neighbouring labels over all chains."""
    order = np.argsort(-counts, kind="stable")
    gain, counts = gain[order], counts[order]
    n, length = gain.shape
    on = [int(k) for k in np.searchsorted(-counts, -np.arange(length), "left")]  # chains longer than t, which come first
    e, s = np.stack([np.zeros_like(gain), gain], 2), np.exp(step - step.max())
    e = np.exp(e - e.max(axis=2, keepdims=True))
    ahead, back = np.ones((length, n, 2)), np.ones((length, n, 2))
    ahead[0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        k = on[t]
        f = (ahead[t - 1, :k] @ s) * e[:k, t]
        ahead[t, :k] = f / f.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(length - 1, 0, -1):
        k = on[t]
        m = e[:k, t] * back[t, :k]
        p = ahead[t - 1, :k, :, None] * s[None] * m[:, None, :]
        pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
        c = m @ s.T
        back[t - 1, :k] = c / c.sum(1, keepdims=True)
    both = ahead * back
    out = np.empty_like(gain)
    out[order] = (both[:, :, 1] / both.sum(2)).T
    return out, pairs


def constrained(gain: np.ndarray, counts: np.ndarray, step: np.ndarray, weight: np.ndarray, labels: np.ndarray, halvings: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The probability of good at each position, and the expected pairs over all chains, under the distribution nearest to the
    model's that keeps to the share of good lines of each chain's label. weight: (chain, position), zero past a chain's end."""
    part = weight / weight.sum(1, keepdims=True)
    sign, bound = np.where(labels == 1, 1.0, -1.0), np.where(labels == 1, GOOD_SHARE, BAD_SHARE)

    def kept(bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, pairs = forward_backward(gain + (sign * bias * counts)[:, None] * part, counts, step)
        return p, pairs, sign * ((p * part).sum(1) - bound) >= 0

    p, pairs, fine = kept(np.zeros(len(counts)))
    if fine.all():
        return p, pairs
    low, high = np.zeros(len(counts)), np.where(fine, 0.0, 64.0)
    for _ in range(halvings):
        middle = (low + high) / 2
        _, _, fine = kept(middle)
        low, high = np.where(fine, low, middle), np.where(fine, middle, high)
    return kept(high)[:2]


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 60, turns: int = 4, ridge: float = 1e-3, rate: float = 0.08) -> Model:
    """Maximum likelihood with a ridge, by Adam from zero: `rounds` with the documents' labels and the lines' own features, then in `turns` turns a third of
    that each with the labels inferred. The same rows give the same model."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    z, lines = (x - mean) / spread, len(x)
    live = np.arange(int(counts.max())) < counts[:, None]
    weight = _padded(np.exp(x[:, 0]), counts)  # the first feature is the logarithm of a line's length
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    y, moves = np.repeat(labels, counts).astype(np.float64), np.diag([float((counts - 1)[labels == k].sum()) for k in (0, 1)])
    for turn in range(turns + 1):
        if turn:
            p, moves = constrained(_padded(z @ w, counts), counts, step, weight, labels)
            y = p[live]
        want, m, v = z.T @ y, np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        free = np.ones(len(w) + 4)
        free[len(FEATURES) : -5] = turn > 0
        free[-4:] = turn > 0
        for i in range(1, (rounds // 3 if turn else rounds) + 1):
            p, pairs = forward_backward(_padded(z @ w, counts), counts, step)
            g = np.r_[(want - z.T @ p[live]) / lines - ridge * w, ((moves - pairs) / lines - ridge * step).ravel()] * free
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            w, step = w + d[:-4], step + d[-4:].reshape(2, 2)
    w = w / spread
    w[-1] -= float(w[:-1] @ mean[:-1])
    return Model(w, step)


def good_shares(texts: list[bytes], model: Model, cells: int = 200_000) -> np.ndarray:
    """The score of each text."""
    x, weight, counts = line_features(texts)
    gain, at = x @ model.weights, np.r_[0, np.cumsum(counts)]
    out, order, lo = np.empty(len(texts)), np.argsort(counts, kind="stable"), 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and counts[order[hi]] * (hi + 1 - lo) <= cells and (counts[order[hi]] <= 2 * counts[order[lo]] + 4):
            hi += 1
        who = order[lo:hi]
        rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in who])
        p, _ = forward_backward(_padded(gain[rows], counts[who]), counts[who], model.step)
        w = _padded(weight[rows], counts[who])
        out[who] = (p * w).sum(1) / w.sum(1)
        lo = hi
    return np.clip(out, 0.0, 1.0)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Model:
    """From labelled documents that aren't held out."""
    prepare(docs.sparkSession)
    some = labels.where(~held_out(id_col) & F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).orderBy(F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`")).select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{label_col}`").cast("int").alias("_label")).limit(max_docs)
    src = picked(docs, id_col, text_col)
    rows = src.join(F.broadcast(some), F.col("_id") == F.col("_key")).select("_id", "_label", "_text")  # max_docs rows at most are broadcast
    lines = rows.agg(F.sum(F.coalesce(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, _, counts = line_features([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
                at = np.r_[0, np.cumsum(counts)]
                cuts = [(k, part, lo, min(lo + max_lines, at[k + 1])) for k in range(len(counts)) for part, lo in enumerate(range(at[k], at[k + 1], max_lines))]
                who = pa.array([k for k, *_ in cuts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array([c[1] for c in cuts], pa.int32()), pa.array([x[lo:hi].ravel().astype(np.float32) for _, _, lo, hi in cuts], pa.list_(pa.float32()))], names=["_id", "_label", "_part", "x"])

    found = rows.mapInArrow(run, f"_id {id_type(src)}, _label int, _part int, x array<float>")
    if lines > max_docs * max_lines:
        found = found.where(F.pmod(F.xxhash64("_id", "_part"), F.lit(lines)) < max_docs * max_lines)
    got = found.orderBy(F.xxhash64("_id", "_part"), "_id", "_label", "_part").limit(3 * max_docs).toPandas().sort_values(["_id", "_label", "_part"], kind="stable")
    if not len(got):
        return blank()
    parts = [np.asarray(v, np.float64).reshape(-1, WIDTH) for v in got["x"]]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), got["_label"].to_numpy())


def line_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    src = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = good_shares([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["_id", "score", "predicted"])

    return src.mapInArrow(run, f"_id {id_type(src)}, score double, predicted int").select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model scores at threshold or more; nothing is shuffled."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(good_shares([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], model) >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of words (lower case, letters and digits; in scripts without spaces each character is a word). An item
of n words leaks into a document if some stretch of it is within edit distance floor(0.2 n), in words. The CGK walk copies
a sequence symbol by symbol and, by a random bit for each step and symbol, moves on or stays, so that edit distance becomes
Hamming distance. Repetition r keeps the symbols at a few random steps of walk r as a hash, one step of each of PARTS of
the walk. What shares a hash with an item is checked over the whole item by exact edit distance.

Items are cut into equal windows of WINDOW to 2 * WINDOW - 1 words (an item with fewer is one window): of the windows of an
item within its distance one at least is within its own, as the edits of all sum up to no more. Every window of every
document is embedded, from each of its words on and for 2 * WINDOW steps, which is the walk over the shortest window.
REPEATS repetitions bring the recall at the largest distance allowed over 0.9 (measured in the tests for substitutions,
insertions and deletions and for up to 1,000 words).

The walks of all windows of a block of texts go on side by side, and a window leaves a repetition at the first of the
sampled steps that no item agrees with; as most leave at the first one, that one lies early in the walk.

The benchmark is handled in blocks of at most BLOCK_CHARS characters (or one item), each broadcast within that bound, one
scan of the documents a block. Documents aren't shuffled.

Defined cases: null and empty texts match nothing; items of fewer than least_words words match nothing, and those of 1 to 4
words, if asked for, match exact copies alone (their distance is 0); null ids are carried; repeated rows and items give
repeated results; empty tables give empty results; other columns are ignored by the search and kept by drop_contaminated.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_type, picked, prepare

SHARE, MIN_WORDS = 0.2, 5
REPEATS, WINDOW = 44, 10
#: Parts of a walk that a sampled step is drawn from, in twentieths of the walk; and those for items of less than a window.
PARTS, SHORT_PARTS = ((0, 3), (3, 7), (7, 13), (13, 20)), ((0, 8), (8, 14), (14, 20))
BLOCK_CHARS = 8_000_000
#: Words of documents embedded at a time.
BLOCK_WORDS = 1 << 16
_APART = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: Letters and marks of scripts that put no spaces between words: Thai, Lao, Burmese, Khmer, Chinese and Japanese.
_UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ebd\u0ec0-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u109d\u1780-\u17d3\u17d7\u3005-\u3007\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_OTHER, _ALONE = re.compile(rf"[^\w\x00-\x7f{_UNSPACED}]+"), re.compile(f"([{_UNSPACED}])")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, in lower case, as UTF-8; characters of scripts without spaces stand alone."""
    t = (text or "").lower()
    if not t.isascii():
        t = _ALONE.sub(r" \1 ", _OTHER.sub(" ", t))
    return t.encode("utf-8", "surrogatepass").translate(_APART).split()


def allowed(n: int, share: float = SHARE) -> int:
    return int(share * n + 1e-9)


def best_stretch(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """Least edit distance of the item to a stretch of text, and that stretch (start, end); None if over most. Of equal
    ones the first that ends. This is the plain way, for checks; its time is the product of the lengths."""
    prev, born = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, w in enumerate(item, 1):
        row, from_ = [i], [0]
        for j, x in enumerate(text, 1):
            cost, at = prev[j - 1] + (w != x), born[j - 1]
            if prev[j] + 1 < cost:
                cost, at = prev[j] + 1, born[j]
            if row[-1] + 1 < cost:
                cost, at = row[-1] + 1, from_[-1]
            row.append(cost)
            from_.append(at)
        prev, born = row, from_
        if min(prev) > most:
            return None
    end = min(range(len(prev)), key=prev.__getitem__)
    return (prev[end], born[end], end) if prev[end] <= most else None


def least_end(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of text, and where the first such stretch ends (Myers' bit vectors)."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best, end = score, 0
    for j, x in enumerate(text, 1):
        eq = at.get(x, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            if score < best:
                best, end = score, j
        more, less = more << 1, less << 1
        up, down = (less | ~(v | more)) & full, more & v & full
    return best, end


def furthest_start(item: list[int], before: list[int], d: int) -> int:
    """How many of the words `before`, read backwards from its end, the item is at distance d of; of several, the most."""
    at: dict[int, int] = {}
    for i, w in enumerate(reversed(item)):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    out = 0
    for j, x in enumerate(reversed(before), 1):
        eq = at.get(x, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        score += bool(more & top) - bool(less & top)
        if score == d:
            out = j
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(v | more)) & full, more & v & full
    return out


@dataclass(frozen=True)
class Tables:
    """What a repetition knows of the items' windows of a length: bits has a random bit for each symbol and step, places the
    sampled steps. filters: Bloom filters of the symbols at the first of these, at the first two, and so on; keys: the hashes,
    in order, and from which to which member of windows each has."""

    bits: np.ndarray
    places: tuple[int, ...]
    filters: tuple[np.ndarray, ...]
    keys: np.ndarray
    edges: np.ndarray
    windows: np.ndarray


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    key = (key ^ symbol.astype(np.uint64)) * _MIX
    return key ^ (key >> np.uint64(29))


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return (key & np.uint64(size - 1)).astype(np.int64)


class Index:
    """A block of items, for a task."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, repeats: int = REPEATS, least_words: int = MIN_WORDS, seed: int = 17):
        self.share = share
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for key, text in items:
            words = words_of(text)
            if len(words) >= max(1, least_words):
                self.items.append((key, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        #: Item, first word in it, words.
        self.pieces: list[tuple[int, int, list[int]]] = []
        for k, (_, words) in enumerate(self.items):
            parts = max(1, len(words) // WINDOW)
            cuts = [len(words) * j // parts for j in range(parts + 1)]
            self.pieces += [(k, a, words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        #: Steps of a walk: over WINDOW words, over half as many for shorter items, and over all words of those that match
        #: exactly, where one repetition is enough.
        by_steps: dict[int, list[int]] = defaultdict(list)
        for k, (_, _, words) in enumerate(self.pieces):
            by_steps[2 * WINDOW if len(words) >= WINDOW else WINDOW if len(words) >= MIN_WORDS else len(words)].append(k)
        #: Of each window: its words, their number and the distance allowed.
        self.size = np.array([len(words) for *_, words in self.pieces], np.int64)
        self.most = np.array([allowed(n, share) for n in self.size.tolist()], np.int64)
        self.words = np.full((len(self.pieces), int(self.size.max(initial=0))), -1, np.int32)
        for k, (*_, words) in enumerate(self.pieces):
            self.words[k, : len(words)] = words
        rng = np.random.default_rng(seed)
        self.tables = [self._tables(np.array(which), steps, rng) for steps, which in sorted(by_steps.items()) for _ in range(repeats if steps >= MIN_WORDS else 1)]

    def _tables(self, which: np.ndarray, steps: int, rng: np.random.Generator) -> Tables:
        bits = rng.integers(0, 2**32, len(self.vocabulary) + 1, dtype=np.uint32)
        places = tuple(int((a + rng.random() * (b - a)) * steps / 20) for a, b in (PARTS if steps == 2 * WINDOW else SHORT_PARTS))
        n, words = self.size[which], np.c_[np.maximum(self.words[which], 0), np.zeros(len(which), np.int32)]
        at, rows, seen = np.zeros(len(which), np.int64), np.arange(len(which)), {}
        for step in range(steps):
            symbol = words[rows, np.minimum(at, n)]
            if step in places:
                seen[step] = symbol
            at = at + ((bits[symbol] >> np.uint32(step)) & np.uint32(1))
        got = [seen[p] for p in places]
        whole = np.all([g > 0 for g in got], axis=0)  # the walk of a short window may end before
        which, (key, *more) = which[whole], (g[whole] for g in got)
        filters = [np.zeros(len(self.vocabulary) + 1, bool)]
        filters[0][key] = True
        key = key.astype(np.uint64)
        for symbol in more:
            key = _mixed(key, symbol)
            filters.append(np.zeros(1 << max(12, (16 * len(which)).bit_length()), bool))
            filters[-1][_slots(key, len(filters[-1]))] = True
        order = np.argsort(key, kind="stable")
        keys, start = np.unique(key[order], return_index=True)
        return Tables(bits, places, tuple(filters), keys, np.r_[start, len(order)], which[order])

    @staticmethod
    def _walk(bits: np.ndarray, at: np.ndarray, start: int, end: int) -> np.ndarray:
        for step in range(start, end):
            at = at + ((bits.take(at) >> np.uint32(step)) & np.uint32(1))
        return at

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids from which a window shares a hash with a window of an item, and that window. ids: words of texts, 0
        for words of no item, between texts and, as many as a walk has steps, at the end."""
        n, found = len(ids) - 2 * WINDOW, []
        for t in self.tables:
            if not len(t.keys):
                continue
            bits = t.bits.take(ids)
            at = self._walk(bits, np.arange(n), 0, t.places[0])
            key = ids.take(at)
            live = np.flatnonzero(t.filters[0].take(key))
            at, key = at[live], key[live].astype(np.uint64)
            for before, place, known in zip(t.places, t.places[1:], t.filters[1:], strict=False):
                at = self._walk(bits, at, before, place)
                key = _mixed(key, ids.take(at))
                some = np.flatnonzero(known[_slots(key, len(known))])
                at, key, live = at[some], key[some], live[some]
            place = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
            some = np.flatnonzero(t.keys[place] == key)
            lo, size = t.edges[place[some]], np.diff(t.edges)[place[some]]
            which = t.windows[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
            found.append((np.repeat(live[some], size), which))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def plausible(self, ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Which of the candidates hold enough of the window's words, within its distance of its place, to match it."""
        out = np.zeros(len(at), bool)
        reach = np.arange(-int(self.most.max(initial=0)), self.words.shape[1] + int(self.most.max(initial=0)))
        for lo in range(0, len(at), 1 << 14):
            w = which[lo : lo + (1 << 14)]
            place = at[lo : lo + (1 << 14), None] + reach
            near = (reach >= -self.most[w, None]) & (reach < (self.size + self.most)[w, None]) & (place >= 0) & (place < len(ids))
            around = np.where(near, ids[np.clip(place, 0, len(ids) - 1)], 0)
            there = (self.words[w][:, :, None] == around[:, None, :]).any(axis=2).sum(axis=1)
            out[lo : lo + (1 << 14)] = there >= (self.size - self.most)[w]
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text and item found: item id, words of the item, distance, first word and end of the stretch."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        get, zero = self.vocabulary.get, repeat(0)
        sequences = [np.fromiter(map(get, w, zero), np.int32, len(w)) for w in map(words_of, texts)]
        lo = 0
        while lo < len(sequences):
            hi, size = lo, 0
            while hi < len(sequences) and (hi == lo or size + len(sequences[hi]) < BLOCK_WORDS):
                size += len(sequences[hi]) + 1
                hi += 1
            for k, hits in self._block(sequences[lo:hi]):
                out[lo + k] = hits
            lo = hi
        return out

    def _block(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]:
        """The items found in each sequence that has any."""
        gap = np.zeros(1, np.int32)
        ids = np.concatenate([x for seq in sequences for x in (seq, gap)] + [np.zeros(2 * WINDOW, np.int32)])
        edges = np.cumsum([0] + [len(seq) + 1 for seq in sequences])
        at, which = np.divmod(np.unique(np.ravel_multi_index(self.candidates(ids), (len(ids), len(self.pieces)))), len(self.pieces))
        good = self.plausible(ids, at, which)
        at, which = at[good], which[good]
        if not len(at):
            return
        item_of, first_of = (np.array([p[x] for p in self.pieces], np.int64) for x in (0, 1))
        text = np.searchsorted(edges, at, "right") - 1
        rows = np.unique(np.stack([text, item_of[which], at - edges[text] - first_of[which]]), axis=1)
        cuts = np.flatnonzero(np.r_[True, (np.diff(rows[:2], axis=1) != 0).any(axis=0)])
        best: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.shape[1]], strict=True):
            k, item = int(rows[0, lo]), int(rows[1, lo])
            got = self._nearest(sequences[k], item, rows[2, lo:hi].tolist())
            if got:
                key, words = self.items[item]
                best[k].append((key, len(words), *got))
        yield from best.items()

    def _nearest(self, text: np.ndarray, item: int, starts: list[int]) -> tuple[int, int, int] | None:
        """The item's least distance near one of the starts, and that stretch; None if none is allowed."""
        words = self.items[item][1]
        most, near, best = allowed(len(words), self.share), [], None
        for s in starts:  # in order; stretches of the text, apart, that hold every match
            lo, hi = max(0, s - most), min(len(text), s + len(words) + most)
            if near and lo <= near[-1][1]:
                near[-1][1] = max(hi, near[-1][1])
            else:
                near.append([lo, hi])
        for lo, hi in near:
            part = text[lo:hi].tolist()
            d, end = least_end(words, part)
            if d <= most and (best is None or d < best[0]):
                best = (d, lo + end - furthest_start(words, part[max(0, end - len(words) - d) : end], d), lo + end)
        return best


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about block_chars characters."""
    b = picked(benchmark, id_col, text_col)
    chars = b.agg(F.sum(F.length("_text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        yield sorted(((r["_id"], r["_text"] or "") for r in b.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == k).collect()), key=str)


#: The last index that this worker made, by the name of its block.
_LAST: dict[str, Index] = {}


def _indexed(docs: DataFrame, items: list[tuple[int, str]], share: float, least_words: int) -> Callable[[], Index]:
    """Gives the index of a block on a worker: the items are broadcast, and the index is made once a worker."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def index() -> Index:
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = Index(shared.value, share, least_words=least_words)
        return _LAST[name]

    return index


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, least_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document and item found in it: id, item_id, item_words, distance, first_word, end_word."""
    prepare(docs.sparkSession)
    src = picked(docs, id_col, text_col)
    key = benchmark.schema["item_id"].dataType
    schema = f"_id {id_type(src)}, item_id {key.simpleString()}, item_words long, distance long, first_word long, end_word long"

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        index = _indexed(src, items, share, least_words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = to_arrow_type(key)
            for b in batches:
                found = index().search(b.column(1).to_pylist())
                which = [k for k, f in enumerate(found) for _ in f]
                first, *cols = list(zip(*(x for f in found for x in f), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(first, kind), *(pa.array(c, pa.int64()) for c in cols)], names=["_id", "item_id", "item_words", "distance", "first_word", "end_word"])

        return src.mapInArrow(run, schema)

    out = None
    for items in blocks(benchmark, block_chars=block_chars):
        out = scan(items) if out is None else out.union(scan(items))
    if out is None:
        out = scan([])
    return out.withColumnRenamed("_id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_col: str = "text", block_chars: int = BLOCK_CHARS, least_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def scan(df: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        index = _indexed(df, items, share, least_words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not f for f in index().search(b.column(at).to_pylist())], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for items in blocks(benchmark, block_chars=block_chars):
        docs = scan(docs, items)
    return docs

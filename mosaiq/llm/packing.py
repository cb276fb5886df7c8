"""Packing documents into token windows by best-fit decreasing.

Tokenizing tasks cut each document into full windows and a rest, and write these pieces (a few numbers each, no tokens) as
a table in the shared folder. A full window is a sequence by itself and isn't moved again. The rests are dealt by hash into
groups of about group_rows, as many as their number asks for, and each group is packed by itself: longest first, into the
open window with the least room that suffices, which a segment tree over the remaining capacities finds in log2(window)
steps. Padding beyond the optimum shrinks with the root of the group's size, so groups of tens of thousands lose well under
a percent while any number of groups runs side by side. Rests are dealt by id, place and ids, and rows that repeat all of
these by their count so far in the task, so no group is hot.

Token ids are those of the tokenizer for the whole text, with the end id appended. Byte-level BPE treats each pre-token by
itself, so the ids of a pre-token are kept and reused. Texts that hold an added token's string are encoded directly.

Defined cases: a null or empty text is the end id alone; null ids are carried; repeated rows are packed once each; an
empty table gives an empty result; other columns are ignored. A document of any length is cut, never dropped. A task
holds the rests of its groups, and no full window.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, picked, prepare, written

WINDOW, END_ID = 2048, 1
#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this family.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Where a single space has other characters than white space on both sides; the space goes with what follows.
INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Units kept a worker, the longest that is kept, and bytes of text encoded at a time.
MEMO_ENTRIES, MEMO_CHARS, BLOCK_BYTES = 900_000, 48, 8 << 20
#: Rows that a task remembers to tell repeated ones apart.
SEEN_ROWS = 200_000
#: Stands before a unit that has no space before it.
CUT = "\x01"
#: Patterns and replacements that cut a text into units: marks after a letter or digit (but for the apostrophe, which begins
#: other pre-tokens), and line ends before other characters.
AFTER_WORD = (r"([\p{L}\p{N}])([!-&(-/:-@\[-`{-~])", rf"\1 {CUT}\2")
LINE_END = (r"(\n+)([^\s])", rf" {CUT}\1 {CUT}\2")
#: Stands for the ids of a unit that isn't looked up.
LOOSE = bytes(4)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Little-endian 32-bit ids of texts.

    A space between two other characters always starts a pre-token, so does a mark after a letter or digit, and line ends
    are pre-tokens between other characters. Texts are cut at these places into units, mostly a pre-token each, and each unit
    that differs is looked up once a call. Ids of units are kept from call to call in two generations, of which the older
    one goes when the younger is full. A unit that touches other white space isn't looked up: texts that hold one are cut
    by a pattern that leaves such places whole.

    A unit is kept as it is if a space stands before it, else with CUT before it."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.direct(["\n"])[0]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, with a space before them or not, many to a call: a line end between them is one token."""
        ids = np.frombuffer(self.direct(["\n".join(words)])[0], "<u4")
        if len(self.line) == 4:
            ends = np.flatnonzero(ids == int.from_bytes(self.line, "little"))
            if len(ends) == len(words) - 1:
                data, cut = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
                return [data[s + 4 : e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
        return self.direct(words)

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their pre-tokens."""
        words = [PRE_TOKEN.findall(t) for t in texts]
        new = list(set().union(*words))
        ids = dict(zip(new, self.direct(new), strict=True))
        return [b"".join(map(ids.__getitem__, w)) for w in words]

    def _learn(self, units: list[str]) -> None:
        words, shown, other = [], [], []
        for u in units:
            text = u[1:] if u[:1] == CUT else u
            if text.isalpha():
                words.append(u)
                shown.append(text if u[0] == CUT else " " + u)
            elif u == CUT:
                self.young[u] = b""
            elif u[:1] == CUT and not text.strip("\n"):  # of line ends before other characters the last stands alone
                self.young[u] = b"".join(self.direct([text[1:]])) + self.line
            elif not text or len(text.strip()) != len(text):
                self.young[u] = LOOSE
            else:
                other.append(u)
        for lo in range(0, len(words), 1024):
            self.young.update(zip(words[lo : lo + 1024], self._words(shown[lo : lo + 1024]), strict=True))
        for lo in range(0, len(other), 4096):
            part = other[lo : lo + 4096]
            self.young.update(zip(part, self._split([u[1:] if u[0] == CUT else " " + u for u in part]), strict=True))

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units; LOOSE if one isn't looked up."""
        if len(self.young) > MEMO_ENTRIES // 2:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, units))
        missing = [k for k, x in enumerate(out) if x is None]
        if missing:
            new = [units[k] for k in missing]
            got = list(map(self.old.get, new))
            self._learn([u for u, x in zip(new, got, strict=True) if x is None])
            self.young.update((u, x) for u, x in zip(new, got, strict=True) if x is not None)
            for k, x in zip(missing, map(self.young.__getitem__, new), strict=True):
                out[k] = x
            for u in new:
                if len(u) > MEMO_CHARS:
                    self.young.pop(u, None)
        return out

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        cut = pc.replace_substring_regex(pc.replace_substring_regex(texts, *AFTER_WORD), *LINE_END)
        lists = pc.split_pattern(cut, " ")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        cuts, words = cuts - cuts[0], lists.flatten()
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        pool = self._units(coded.dictionary.to_pylist())
        first = len(pool)
        heads = words.take(pa.array(cuts[:-1])).to_pylist()
        pool += self._units([CUT + w for w in heads])
        pool.append(b"")
        at[cuts[:-1]] = first + np.arange(len(texts))
        loose = np.zeros(len(pool), bool)
        loose[[k for k, x in enumerate(pool) if x is LOOSE]] = True
        slow = np.array([len(w.strip()) != len(w) for w in heads], bool)
        slow[np.searchsorted(cuts, np.flatnonzero(loose[at]), "right") - 1] = True
        for a in (CUT, *self.added):
            slow |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        at[np.repeat(slow, cuts[1:] - cuts[:-1])] = len(pool) - 1
        for k in np.flatnonzero(slow).tolist():
            at[cuts[k]] = first + k
            pool[first + k] = self._whole(texts[k].as_py())
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        data, place = np.frombuffer(b"".join(pool), "<u4"), np.cumsum(size) - size
        n = size[at]
        end = np.cumsum(n)
        return data[np.repeat(place[at] - end + n, n) + np.arange(end[-1] if len(end) else 0)], end[cuts[1:] - 1]

    def _whole(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.direct([text])[0]
        return b"".join(self._split(INNER_SPACE.split(text)))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if texts:
            ids, ends = self.flat(pa.array(texts, pa.string()))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                yield ids[lo:hi].tobytes()


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One for each worker and tokenizer, kept from task to task."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows of each document, then its rest: _id, start, length, ids_crc32, doc_tokens, and _copy, which counts the
    rows of the task (the last SEEN_ROWS of them, at least) that are the same in id, place and ids."""
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB whatever the input
    src = picked(docs, id_col, text_col)

    def block(encode: Encoder, ids: pa.Array, texts: pa.Array, seen: dict) -> pa.RecordBatch:
        tokens, ends = encode.flat(texts)
        tokens = np.insert(tokens, ends, end_id).astype("<u4", copy=False)
        ends = ends + np.arange(1, len(ends) + 1)
        total = np.diff(ends, prepend=0)
        pieces = -(-total // window)
        which = np.repeat(np.arange(len(total)), pieces)
        start = window * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(window, total[which] - start)
        lo = (ends - total)[which] + start
        data = memoryview(tokens.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(lo.tolist(), length.tolist(), strict=True)]
        ids, copy = ids.take(pa.array(which)), []
        if len(seen) > SEEN_ROWS:
            seen.clear()
        for key in zip(ids.to_pylist(), start.tolist(), crc, strict=True):
            copy.append(seen.get(key, 0))
            seen[key] = copy[-1] + 1
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (start, length, crc, total[which], copy))], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "_copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(shared.value), {}
        for b in batches:
            if b.num_rows:
                texts = pc.fill_null(b.column(1), "")
                part = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // BLOCK_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    yield block(encode, b.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), seen)

    return src.mapInArrow(run, f"_id {id_type(src)}, start long, length long, ids_crc32 long, doc_tokens long, _copy long")


class Windows:
    """Open windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least need: its room and number."""
        k, count = need + self.leaves, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each length; windows are numbered from 0. Ties go in the order given."""
    tree, n = Windows(window), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.tightest(lengths[i]) if lengths[i] < window else None
        room, w = got or (window, n)
        n += got is None
        where[i], offset[i] = w, window - room
        if room > lengths[i]:
            tree.add(room - lengths[i], w)
    return where, offset


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, group_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Sequences that are one full
    window have odd ids."""
    pieces = written(token_pieces(docs, tokenizer, window, end_id, id_col, text_col), "pieces")
    full = pieces.where(F.col("length") == window).drop("_copy")
    full = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where(F.col("length") < window)
    groups = max(1, -(-rests.count() // group_rows))
    dealt = rests.withColumn("_group", F.pmod(F.xxhash64("_id", "start", "ids_crc32", "_copy"), F.lit(groups)).cast("long")).drop("_copy").repartition(groups, "_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("_group", "ascending"), ("length", "descending"), ("_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = t.column("_group").to_numpy()
        edges = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = t.slice(lo, hi - lo)
            where, offset = best_fit_decreasing(part.column("length").to_pylist(), window)
            part = part.drop_columns(["_group"]).append_column("sequence_id", pa.array(2 * (np.array(where, np.int64) + (int(group[lo]) << 32)))).append_column("offset", pa.array(offset, pa.int64()))
            yield from part.combine_chunks().to_batches()

    packed = dealt.mapInArrow(run, f"_id {id_type(pieces)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.union(packed).withColumnRenamed("_id", id_col)

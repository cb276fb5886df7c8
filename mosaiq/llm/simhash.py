"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Radius 3 is odd, so it is first made even: the 64 bits are split in three parts, and of three differing bits at least
one lies in some part. Leaving that part out leaves at most two differing bits, which meet half way: every fingerprint
emits, for each part left out, its other bits and all variants of them within radius 1 (1 + 43 keys or 1 + 42). Two
fingerprints at distance 3 or less share such a key; rows are dealt by key, and each colliding pair is verified on its
64 bits, at one key only (the canonical one), so that no pair counts twice. A task returns the spanning forest of its
verified pairs, never all pairs. 131 rows of two integers a distinct fingerprint are shuffled, against 2,081 if every
fingerprint emitted its whole ball of radius 2.

Equal fingerprints are one node, so copies cost nothing however many there are. Many distinct fingerprints may still share
a key. A key's fingerprints have, in the bits that it keeps, at most one bit other than it, so if no value of these bits
(three a fingerprint, counted before) has HEAVY fingerprints or more, no key has over 44 x HEAVY. Keys next to a heavier
value are taken out and their fingerprints are linked by full-ball hashing instead (see ball_rows): about 600 rows each,
but any key has 1,057 of them at most, whatever the data, and a hub for them needs no pairs. So both ways deal bounded
groups over tasks, and the cost is linear in the number of fingerprints.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of one or two words are one
shingle; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored. Null ids
get a fingerprint and the component of their fingerprint, but never name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, picked, prepare, written
from .components import components, local_roots

RADIUS = 3
#: First and last bit (exclusive) of the part that is left out.
PARTS = ((0, 21), (21, 42), (42, 64))
#: Fingerprints that share a key: beyond it pairs aren't compared one by one. And those of one value of the bits kept.
LONG_RUN, HEAVY = 512, 64
#: Keys that may be broadcast: 8 MB.
BROADCAST_KEYS = 1_000_000
_ONE = np.uint64(1)


def _mask(lo: int, hi: int) -> np.uint64:
    return np.uint64(sum(1 << b for b in range(lo, hi)))


#: For each part: the bits kept, a tag in the bits left out, and the flips that make the ball.
TABLES = tuple((~_mask(lo, hi), np.uint64((k + 1) << lo), np.array([0] + [1 << b for b in range(64) if not lo <= b < hi], np.uint64)) for k, (lo, hi) in enumerate(PARTS))
KEYS = sum(len(t[2]) for t in TABLES)


def fingerprint(data: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (data or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    text, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.array([digest(text[s : e - 1], seed) for s, e in zip(starts[lo:hi], ends[lo + k - 1 : hi + k - 1], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and _fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    src = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["_id", "_fp"])

    return src.mapInArrow(run, f"_id {id_type(src)}, _fp long")


def ball_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint, and the fingerprint of each key."""
    keys = np.concatenate([(((fp & keep)[:, None] ^ flips[None, :]) | tag).ravel() for keep, tag, flips in TABLES])
    return keys, np.concatenate([np.repeat(fp, len(flips)) for _, _, flips in TABLES])


def canonical(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one key at which a pair within the radius counts: of the first part whose loss leaves two differing bits or
    fewer, the lesser of the points half way."""
    diff, out, done = x ^ y, np.zeros(len(x), np.uint64), np.zeros(len(x), bool)
    for keep, tag, _ in TABLES:
        d = diff & keep
        n = np.bitwise_count(d)
        here = ~done & (n <= 2)
        low = d & (~d + _ONE)  # the lowest differing bit
        a, b = x & keep, y & keep
        key = np.where(n == 0, a, np.where(n == 1, np.minimum(a, b), np.minimum(a ^ low, b ^ low)))
        out[here] = (key | tag)[here]
        done |= here
    return out


_ONES = np.array([0] + [1 << b for b in range(64)], np.uint64)
_TWOS = np.array([1 << a | 1 << b for h in (0, 32) for a in range(h, h + 32) for b in range(a + 1, h + 32)], np.uint64)


def ball_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their fingerprints, and whether the key is within radius 1 of it. A fingerprint of even parity emits its ball of
    radius 1, one of odd parity that and its two-bit variants with both bits in the same half. Of three differing bits two
    lie in the same half, so pairs at distance 3 (or 1) of unlike parity meet, as do pairs at distance 2 of like parity; and
    whatever meets a member of a radius-1 ball is within 1 + 2 of it, so no check is needed: all that share a key with such a
    member hang on it."""
    odd = fp[np.bitwise_count(fp) % 2 == 1]
    keys = np.concatenate([(fp[:, None] ^ _ONES).ravel(), (odd[:, None] ^ _TWOS).ravel()])
    who = np.concatenate([np.repeat(fp, len(_ONES)), np.repeat(odd, len(_TWOS))])
    return keys, who, np.arange(len(keys)) < len(fp) * len(_ONES)


def hub_links(keys: np.ndarray, who: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all rows of a key to one that is near it."""
    order = np.lexsort((~near, keys))
    k, w, s = keys[order], who[order], near[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    hub = np.repeat(first, np.diff(np.r_[first, len(k)]))
    take = s[hub] & (hub != np.arange(len(k)))
    return w[take], w[hub[take]]


def ball_links(fp: np.ndarray, passes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as all pairs within the radius. Rows are made in `passes` parts, by the key's hash."""
    fp = np.unique(fp)
    keys, who, near = ball_rows(fp)
    part = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes)
    found = [hub_links(keys[part == p], who[part == p], near[part == p]) for p in range(passes)]
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def verified(keys: np.ndarray, fp: np.ndarray, long_run: int = LONG_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that share a key."""
    order = np.lexsort((fp, keys))
    keys, fp = keys[order], fp[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (fp[1:] != fp[:-1])] if len(keys) else np.zeros(0, bool)
    keys, fp = keys[fresh], fp[fresh]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    length = np.diff(np.r_[first, len(keys)])
    us, vs = [], []
    for k in np.flatnonzero(length > long_run):
        u, v = ball_links(fp[first[k] : first[k] + length[k]])
        us.append(u)
        vs.append(v)
    some = (length > 1) & (length <= long_run)
    for d in range(1, int(length[some].max()) if some.any() else 0):
        runs = some & (length > d)
        n = length[runs] - d
        at = np.repeat(first[runs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        x, y = fp[at], fp[at + d]
        near = np.bitwise_count(x ^ y) <= RADIUS
        x, y, key = x[near], y[near], keys[at[near]]
        own = canonical(x, y) == key
        us.append(x[own])
        vs.append(y[own])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _arrays(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of all batches: longs as unsigned ones."""
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [x.view(np.uint64) if x.dtype == np.int64 else x for x in map(np.concatenate, zip(*got, strict=True))]


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    node, root = local_roots(u.view(np.int64), v.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])


def hot_keys(nodes: DataFrame, fp_col: str = "_fp", heavy: int = HEAVY) -> DataFrame:
    """The keys next to a value of the bits kept that has `heavy` fingerprints or more; every key that more than 44 x heavy
    fingerprints share is among them."""

    def signed(x: np.uint64) -> Column:
        return F.lit(int(x.view(np.int64)))

    kept = F.array(*(F.struct(F.lit(k).alias("table"), F.col(fp_col).bitwiseAND(signed(keep)).alias("kept")) for k, (keep, _, _) in enumerate(TABLES)))
    values = nodes.select(F.explode(kept).alias("x")).groupBy("x.table", "x.kept").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= heavy)
    flips = F.array(*(F.array(*(F.struct(signed(x).alias("flip"), signed(tag).alias("tag")) for x in f)) for _, tag, f in TABLES))
    return values.select(F.explode(F.get(flips, F.col("table"))).alias("f"), "kept").select(F.col("kept").bitwiseXOR(F.col("f.flip")).bitwiseOR(F.col("f.tag")).alias("hot")).distinct()


def fingerprint_links(nodes: DataFrame, fp_col: str = "_fp", rows_per_task: int = 2_000_000, heavy: int = HEAVY) -> DataFrame:
    """u, v: links that join the same fingerprints as all pairs at distance 3 or less. nodes: distinct fingerprints."""
    spark = nodes.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, fp = ball_keys(b.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _arrays(batches)
        if got:
            yield _forest(*verified(*got))

    def emit_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                keys, who, near = ball_rows(b.column(0).slice(lo, 500).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who.view(np.int64)), pa.array(near)], names=["key", "fp", "near"])

    def meet_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _arrays(batches)
        if got:
            yield _forest(*hub_links(*got))

    emitted = nodes.select(fp_col).mapInArrow(emit, "key long, fp long")
    hot, dense = written(hot_keys(nodes, fp_col, heavy), "hot-keys"), None
    n = hot.count()
    if n:
        hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
        dense = written(emitted.join(hot, F.col("key") == F.col("hot"), "left_semi").select("fp").distinct(), "dense")
        emitted = emitted.join(hot, F.col("key") == F.col("hot"), "left_anti")
    tasks = max(least, nodes.count() * KEYS // rows_per_task + 1)
    links = emitted.repartition(tasks, "key").mapInArrow(meet, "u long, v long")
    if dense is None:
        return links
    tasks = max(least, dense.count() * 600 // rows_per_task + 1)
    return links.union(dense.mapInArrow(emit_balls, "key long, fp long, near boolean").repartition(tasks, "key").mapInArrow(meet_hubs, "u long, v long"))


def rooted_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: _id, _fp, root (the same for a component's rows alone) and component_id."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("_fp").agg(F.min("_id").alias("rep")), "nodes")
    found = components(fingerprint_links(nodes))
    rooted = nodes.join(found, nodes["_fp"] == found["node"], "left").select("_fp", "rep", F.coalesce("component", "_fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("_fp").alias("fp"), "root", "component_id")
    return fps.join(named, fps["_fp"] == named["fp"]).select("_id", "_fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, fingerprint (16 lowercase hex digits) and component_id, the least id reachable."""
    return rooted_fingerprints(docs, id_col, text_col).select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")

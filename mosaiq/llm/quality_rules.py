"""Quality rules as a short-circuit cascade.

Each rule's cost, given what the base has computed by then, and which rules reject a text together are measured on a sample,
on the executors. The rules then run in the order of rejections per unit of cost among the texts that the rules before
leave, and a document leaves at the first rule that rejects it. The verdict is the conjunction of all rules, so it doesn't
depend on the order; only the time does.

Words are maximal runs of characters other than space and U+0009 to U+000D. Defined cases: a null or empty text has no
words, fails the base and isn't kept; a null id is carried through; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are ignored, whatever their names. Texts are taken whole; memory is
that of one batch of texts.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, picked, prepare

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower() + bytes(range(128, 256))
#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that is was for it with as be by on "
    "le la les des et en un une du que est pour dans qui par "
    "der die das und den von zu mit sich auf für ist im dem "
    "el los las de y una con del se por es su"
).split()
_STOP = frozenset(w.encode() for w in STOP_WORDS)


class Facts:
    """What the rules ask of one text; each is computed when first asked for."""

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass")
        self.chars = len(text or "")

    def base(self) -> tuple[int, int, int, int, int]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes.split() splits at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.chars - sum(map(self.data.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.data.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        total = end = 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))

    @cached_property
    def n_letter_bytes(self) -> int:
        return len(self.data) - len(self.data.translate(None, LETTERS))

    @cached_property
    def n_word_bytes(self) -> int:
        return len(self.data.translate(None, SPACE))


@dataclass(frozen=True)
class Rule:
    """rejects: true if the text fails the rule."""

    name: str
    rejects: Callable[[Facts], bool]


def _bullets(f: Facts) -> bool:
    starts = ("-", "*", "•")
    n = sum(x.lstrip(SPACE).startswith(tuple(s.encode() for s in starts)) for x in f.lines)
    return 10 * n > 9 * len(f.lines)


def _ellipses(f: Facts) -> bool:
    n = sum(x.rstrip(SPACE).endswith((b"...", "…".encode())) for x in f.lines)
    return 10 * n > 3 * len(f.lines)


#: Word length and symbol bounds as in public web-text filters; all bounds are integers, so that any engine agrees.
RULES = (
    Rule("mean_word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 14 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 10 * f.n_dup_lines > 6 * len(f.lines)),
    Rule("upper_case", lambda f: 10 * f.n_upper > 4 * f.n_letter_bytes),
    Rule("letters", lambda f: 10 * f.n_letter_bytes < 6 * f.n_word_bytes),
    Rule("bullets", _bullets),
    Rule("ellipses", _ellipses),
    Rule("stop_words", lambda f: len(_STOP.intersection(f.data.lower().split())) < 2),
)


def base_failed(f: Facts) -> bool:
    return f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words


def rule_statistics(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Over a random sample of about sample_rows rows. A row for each rule: texts tried, texts rejected and nanoseconds taken;
    and, with a null rule, a row for each set of rules that reject the same texts: the rules as bits of `rejecting`, and in
    `rejected` how many texts. Each rule starts from the facts that the base leaves, so its cost is what it adds."""
    prepare(docs.sparkSession)
    n = docs.count()
    sample = docs if n <= sample_rows else docs.sample(fraction=sample_rows / n, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried, ns, sets = 0, [0] * len(rules), Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                f = Facts(text)
                f.base()
                if base_failed(f):
                    continue
                tried, bits = tried + 1, 0
                for k, r in enumerate(rules):
                    g, t = copy(f), time.perf_counter_ns()
                    bits |= bool(r.rejects(g)) << k
                    ns[k] += time.perf_counter_ns() - t
                sets[bits] += 1
        rows = [(r.name, None, tried, sum(c for bits, c in sets.items() if bits >> k & 1), ns[k]) for k, r in enumerate(rules)]
        cols = list(zip(*rows, *((None, bits, 0, c, 0) for bits, c in sets.items()), strict=True))
        kinds = [pa.string()] + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rule", "rejecting", "tried", "rejected", "ns"])

    return picked(sample, id_col, text_col).mapInArrow(run, "rule string, rejecting long, tried long, rejected long, ns long").groupBy("rule", "rejecting").agg(*(F.sum(c).alias(c) for c in ("tried", "rejected", "ns")))


def ordered(rules: tuple[Rule, ...], statistics: list) -> tuple[Rule, ...]:
    """Again and again the rule with the most rejections per nanosecond among the texts that are left (of all texts, where the
    statistics don't say which rules reject together); ties keep the given order, rules without figures come last."""
    by = {r["rule"]: r for r in statistics if r["rule"] is not None and r["tried"]}
    sets = {r["rejecting"]: r["rejected"] for r in statistics if r["rule"] is None}
    left, out = [(k, r) for k, r in enumerate(rules)], []

    def worth(k: int, r: Rule) -> float:
        if r.name not in by:
            return -1.0
        rejected = sum(n for bits, n in sets.items() if bits >> k & 1) if sets else by[r.name]["rejected"]
        return (rejected + 1e-9 * by[r.name]["tried"]) / max(by[r.name]["ns"], 1)

    while left:
        best = max(left, key=lambda x: worth(*x))
        left.remove(best)
        out.append(best[1])
        sets = {bits: n for bits, n in sets.items() if not bits >> best[0] & 1} or ({0: 0} if sets else {})
    return tuple(out)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: the base counts, base_failed, kept, and the rule that rejected it first in the cascade's
    order (null if none). At most one row a rule comes to the driver."""
    prepare(docs.sparkSession)
    cascade = ordered(rules, rule_statistics(docs, rules, sample_rows, id_col=id_col, text_col=text_col).collect())
    src = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                f = Facts(text)
                failed = base_failed(f)
                first = "base" if failed else next((r.name for r in cascade if r.rejects(f)), None)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, first is None, first))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    return src.mapInArrow(run, f"_id {id_type(src)}, {COLUMNS}").withColumnRenamed("_id", id_col)

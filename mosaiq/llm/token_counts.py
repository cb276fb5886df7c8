"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton names every piece that ends at each character; dynamic programming carries, for each position,
the best score and the number of pieces on the way there. Ties go as in the tokenizer: of candidates for one position
the one that starts earliest (the longest piece) stays, and an unknown character counts only where no piece of one
character fits; unknown characters in a row are one token. Spaces become the word mark, and no piece crosses one, so counts of words are kept and reused.

Defined cases: null and empty texts have no tokens; null ids are carried; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored. Words of any length take time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, picked, prepare

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a task keeps, and the longest that it keeps.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores; pieces of several word marks can't occur and stay out."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path or default_model())
    usable = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))
    return [(p, m.get_score(i)) for i in usable if MARK not in (p := m.id_to_piece(i))[1:]]


class Counter:
    """Counts the pieces of a word's best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for p, score in dict(vocabulary).items():
            self.pieces.add_word(p, (len(p), score))
        self.pieces.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0)
        self.unknown = min(self.unknown, 0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def word(self, text: str) -> int:
        best, count, loose, n = [0.0], [0], [False], len(text)
        top, which, single = None, 0, False

        def settle(end: int) -> None:
            """Closes the positions before end; those without a piece of one character take an unknown one, which is
            one token with an unknown one before it."""
            nonlocal top, which, single
            while len(best) < end:
                unknown = False
                if not single:
                    got = best[-1] + self.unknown
                    if top is None or got > top:
                        top, which, unknown = got, count[-1] + (not loose[-1]), True
                best.append(top)
                count.append(which)
                loose.append(unknown)
                top, which, single = None, 0, False

        for last, (size, score) in self.pieces.iter(text) if len(self.pieces) else ():  # by end, longest first
            if len(best) <= last:
                settle(last + 1)
            got = best[last + 1 - size] + score
            if size == 1:
                single = True
            if top is None or got > top:
                top, which = got, count[last + 1 - size] + 1
        settle(n + 1)
        return count[n]

    def __call__(self, texts: list[str | None]) -> list[int]:
        words = []
        for t in texts:
            w = (t or "").replace(MARK, " ").split(" ")
            words.append(w[1:] if not w[0] else w)  # a text that starts with a space gets no further mark
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        new = set().union(*words).difference(memo)
        memo.update((w, self.word(MARK + w)) for w in new)
        out = [sum(map(memo.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_chars."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary if vocabulary is not None else unigram_vocabulary())  # a vocabulary: its size doesn't follow the input
    src = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [x for lo in range(0, len(texts), 200) for x in count(texts[lo : lo + 200])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=["_id", "n_tokens", "n_chars"])

    return src.mapInArrow(run, f"_id {id_type(src)}, n_tokens long, n_chars long").withColumnRenamed("_id", id_col)

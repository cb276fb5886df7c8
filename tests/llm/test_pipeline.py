"""Each stage against what it is to do, and the whole run."""

from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline as cp
import mosaiq.llm
from mosaiq.llm import decontaminate as dc
from mosaiq.llm import line_crf
from test_operators import brute_components, brute_fingerprint, brute_spans


def test_stages(spark, data):
    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "simhash_dedup", "benchmark_decontamination", "secret_scans", "packing"]

    good = cp.written(cp.quality_classifier(spark, docs, sf), "t")
    model = line_crf.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    all_rows = docs.collect()
    scores = line_crf.good_shares([r["text"].encode() for r in all_rows], model)
    assert good.columns == columns and sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r, s in zip(all_rows, scores, strict=True) if s >= 0.3)

    single = cp.written(cp.simhash_dedup(spark, good, sf), "t")
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    group = brute_components([brute_fingerprint(r["text"]) for r in rows])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted({rows[k]["doc_id"] for k in group})

    clean = cp.written(cp.benchmark_decontamination(spark, single, sf), "t")
    items = [" ".join(w.decode() for w in dc.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    normal = {r["doc_id"]: " ".join(w.decode() for w in dc.words_of(r["text"])) for r in single.collect()}
    leaks = {d for d, t in normal.items() if any(f" {i} " in f" {t} " for i in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and leaks and not leaks & left and len(set(normal) - left - leaks) <= 0.02 * len(normal) + 1

    safe = cp.written(cp.secret_scans(spark, clean, sf), "t")
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in safe.collect():
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"]

    packed = cp.packing(spark, safe, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in safe.collect()}
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, packed.collect()))


def test_dedup_of_odd_rows(spark, odd, empty):
    kept = cp.simhash_dedup(spark, odd, "")
    rows = kept.collect()
    assert kept.columns == odd.columns
    named = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(named) == len(set(named)) and {0, 5} <= set(named) and not {1, 2, 6, 7} & set(named)
    assert sum(r["doc_id"] is None for r in rows) == 1 and cp.simhash_dedup(spark, empty, "").count() == 0


def test_dedup_of_rows_that_share_an_id(spark):
    def text(k):
        return " ".join(f"w{k}x{j}" for j in range(60))

    rows = [(1, text(1)), (2, text(2)), (2, text(3)), (2, text(3)), (3, text(4)), (3, text(1)), (4, text(5)), (5, text(3)), (6, None), (6, text(6)), (None, text(1)), (7, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.simhash_dedup(spark, docs, "").collect()
    want = [(1, text(1)), (2, text(2)), (2, text(3)), (3, text(4)), (4, text(5)), (6, None), (6, text(6)), (None, text(1))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_run_over_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "a passage that no document holds at all"), (2, None)], "item_id long, text string")
    for name, docs, rest in (("odd", odd, (labels, benchmark)), ("empty", empty, (labels, benchmark)), ("bare", odd, (labels.limit(0), benchmark.limit(0)))):
        sf = f"{tmp_path}/{name}"
        for table, df in zip(("documents", "labels", "benchmark"), (docs, *rest), strict=True):
            df.write.parquet(f"{sf}/{table}.parquet")
        out = cp.run(spark, sf).collect()
        if name == "bare":  # nothing is learned, so every score is 0.5 and only copies go
            assert {r["doc_id"] for r in out} == {None, 0, 3, 4, 5, 8, 9, 10} or {r["doc_id"] for r in out} == {None, 0, 3, 4, 5, 8, 9}
        assert (not out) == (name == "empty") and all(r["length"] > 0 for r in out)


def test_stages_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    benchmark = spark.createDataFrame([(1, "aa bb cc dd"), (2, "one two three four five six seven")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = {"benchmark_decontamination": 4}  # the four rows of aa bb cc dd
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and stage(spark, empty, str(tmp_path)).count() == 0
        if name != "simhash_dedup":
            assert got.count() == odd.count() - gone.get(name, 0)


def test_no_import_guard_or_local_checkpoint():
    for path in [Path(cp.__file__), *Path(mosaiq.llm.__path__[0]).glob("*.py")]:
        assert not re.search(r"except (Import|ModuleNotFound)Error|localCheckpoint", path.read_text())

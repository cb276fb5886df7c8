"""The parts of the operators that are the methods' own, against brute force, held-out rows and planted structure."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.llm import components as co
from mosaiq.llm import decontaminate as dc
from mosaiq.llm import licenses, line_crf, packing, toxicity, warc
from mosaiq.llm import quality_rules as qr
from mosaiq.llm import secrets as se
from mosaiq.llm import simhash as sh
from test_operators import brute_components, brute_distance, brute_spans, near_fingerprints

# quality rules


def test_cascade_counts_only_texts_that_are_left():
    rules = tuple(qr.Rule(n, lambda f: False) for n in "abc")
    figures = [{"rule": n, "rejecting": None, "tried": 100, "rejected": r, "ns": 1000} for n, r in zip("abc", (50, 40, 20), strict=True)]
    sets = [{"rule": None, "rejecting": bits, "tried": 0, "rejected": n, "ns": 0} for bits, n in ((0b011, 40), (0b001, 10), (0b100, 20), (0, 30))]
    assert [r.name for r in qr.ordered(rules, figures)] == ["a", "b", "c"]
    assert [r.name for r in qr.ordered(rules, figures + sets)] == ["a", "c", "b"]  # b rejects only what a does


def test_rule_statistics_count_each_text_once(docs):
    got = qr.rule_statistics(docs).collect()
    tried = {r["tried"] for r in got if r["rule"]}
    assert len(tried) == 1 and sum(r["rejected"] for r in got if r["rule"] is None) == tried.pop()
    for k, rule in enumerate(qr.RULES):
        assert next(r["rejected"] for r in got if r["rule"] == rule.name) == sum(r["rejected"] for r in got if r["rule"] is None and r["rejecting"] >> k & 1)


# licences


def test_copyright_lines_and_names_with_commas(spark):
    mit = licenses.TEXTS["MIT"]
    found = licenses.license_scan(spark.createDataFrame([(1, f"© 2020 A. Person\n{mit}"), (2, f"Copyright A. Person, 2020\n{mit}"), (3, "mine, all mine")], "doc_id long, text string"))
    assert {r["doc_id"]: r["license"] for r in found.collect()} == {1: "MIT", 2: "MIT", 3: None}
    own = {licenses.hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest(): k for t, k in (("mine, all mine", "A, B and C"), ("licensed under nothing", "D"))}
    got = licenses.license_scan(spark.createDataFrame([(1, "Mine, all mine"), (2, "x\nLicensed under nothing")], "doc_id long, text string"), own).collect()
    assert {r["doc_id"]: (r["license"], r["notices"]) for r in got} == {1: ("A, B and C", ""), 2: (None, "D")}


# SimHash


def dense_fingerprints(n, seed):
    """Many fingerprints around one, some apart."""
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)}
    return np.unique(np.r_[np.array(sorted(near), np.uint64), near_fingerprints(n // 4, seed)])


@pytest.mark.parametrize("heavy", [2, 8, 10_000])
def test_hot_keys_keep_the_components(spark, heavy):
    fp = dense_fingerprints(400, heavy)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "_fp long")
    hot = {r["hot"] for r in sh.hot_keys(nodes, heavy=heavy).collect()}
    keys, counts = np.unique(sh.ball_keys(fp)[0].view(np.int64), return_counts=True)
    assert set(keys[counts > 44 * heavy].tolist()) <= hot and bool(hot) == (heavy < 100)
    found = dict(co.components(sh.fingerprint_links(nodes, heavy=heavy)).collect())
    roots = {}
    for x, k in zip(fp.view(np.int64).tolist(), brute_components(fp.tolist()), strict=True):
        roots.setdefault(k, set()).add(found.get(x, x))
    assert all(len(v) == 1 for v in roots.values()) and len(set.union(*roots.values())) == len(roots)


def test_keys_of_full_balls_are_bounded():
    keys, _, near = sh.ball_rows(dense_fingerprints(3000, 1))
    assert np.unique(keys, return_counts=True)[1].max() <= 1 + 64 + len(sh._TWOS) and near.sum() % 65 == 0


# toxicity


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    x, grade = rng.normal(size=(40, 5)), rng.integers(0, 4, 40)
    point = rng.normal(size=8) / 2
    _, g = toxicity.objective(point, x, grade)
    for k in range(8):
        e = np.eye(8)[k] * 1e-5
        assert abs((toxicity.objective(point + e, x, grade)[0] - toxicity.objective(point - e, x, grade)[0]) / 2e-5 - g[k]) < 1e-6


def test_likelihood_is_that_of_the_grades():
    point, x, grade = np.array([0.7, -0.2, 0.1, 0.3]), np.array([[1.0], [-2.0], [0.5]]), np.array([0, 3, 1])
    theta = [-0.2, -0.2 + math.exp(0.1), -0.2 + math.exp(0.1) + math.exp(0.3)]
    want = 0.0
    for v, g in zip((0.7, -1.4, 0.35), grade, strict=True):
        s = [1.0, *(1 / (1 + math.exp(t - v)) for t in theta), 0.0]
        want += math.log(s[g] - s[g + 1]) / 3
    assert abs(toxicity.objective(point, x, grade, ridge=0.0)[0] + 1e-3 * 0.1 / 2 - want) < 1e-9


def test_fit_reaches_the_top():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    grade = np.searchsorted([-0.5, 0.5, 1.5], x @ [1.0, -0.5, 0.0] + rng.logistic(size=500) / 2)
    w, theta = toxicity.fit(x, grade, rounds=1500)
    point = np.r_[w, theta[0], np.log(np.diff(theta))]
    assert np.abs(toxicity.objective(point, x, grade)[1]).max() < 1e-3


def test_severity_follows_how_much_is_toxic(spark):
    rng, words = random.Random(5), [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "re", "ta") for b in ("dan", "fer", "gil", "hom", "jun")]
    bad = ["vile", "scum", "rotten", "filth"]

    def text(toxic):
        said = [" ".join(rng.choices(words, k=8)) for _ in range(12)]
        for k in rng.sample(range(12), toxic):
            said[k] += " " + rng.choice(bad)
        return ". ".join(said) + "."

    planted = {k: (0 if k % 3 else rng.choice((1, 3, 9))) for k in range(1200)}
    docs = spark.createDataFrame([(k, text(n)) for k, n in planted.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(n > 0)) for k, n in planted.items()], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, toxicity.train(docs, labels)).where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    mean = {n: np.mean([r["severity"] for r in found if planted[r["doc_id"]] == n]) for n in (0, 1, 3, 9)}
    assert mean[0] < 0.2 < 0.6 < mean[1] < mean[3] - 0.3 < mean[9] - 0.6
    none = toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0))).agg(F.max("severity"), F.max("grade")).first()
    assert tuple(none) == (0.0, 0)


# line CRF


def test_constrained_posterior_is_exact():
    rng = np.random.default_rng(6)
    step, counts, labels = rng.normal(size=(2, 2)), np.array([5, 4, 5]), np.array([0, 1, 0])
    live = np.arange(5) < counts[:, None]
    gain, weight = np.where(live, rng.normal(size=(3, 5)) + 2, 0), np.where(live, rng.random((3, 5)) + 0.5, 0)
    gain[1] = np.where(live[1], -1.0, 0)
    p, pairs = line_crf.constrained(gain, counts, step, weight, labels, halvings=40)
    total = np.zeros((2, 2))
    for i, n in enumerate(counts):
        part, sign, bound = weight[i, :n] / weight[i, :n].sum(), 1 if labels[i] else -1, line_crf.GOOD_SHARE if labels[i] else line_crf.BAD_SHARE
        share = float(p[i, :n] @ part)
        assert abs(share - bound) < 1e-6  # the constraint binds here
        low, high = 0.0, 64.0
        for _ in range(60):
            bias, mass, good, moves = (low + high) / 2, 0.0, np.zeros(n), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=int(n)):
                q = math.exp(sum((gain[i, t] + sign * bias * n * part[t]) for t in range(n) if y[t]) + sum(step[a, b] for a, b in itertools.pairwise(y)))
                mass += q
                good += q * np.array(y)
                for a, b in itertools.pairwise(y):
                    moves[a, b] += q
            low, high = (low, bias) if sign * (good / mass @ part - bound) >= 0 else (bias, high)
        assert np.allclose(p[i, :n], good / mass, atol=1e-5)
        total += moves / mass
    assert np.allclose(pairs, total, atol=1e-4)


def test_lines_of_either_kind_are_told_apart_within_a_document():
    """Bad documents hold a plain passage; only documents are labelled."""
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choices(("the", "water", "of", "rivers", "flows", "slowly", "towards", "open", "sea"), k=rng.randint(6, 12))).capitalize() + "."
    junk = lambda: " ".join(rng.choices(("BUY", "$$$", "###", "NOW!!!", "<<<", "|", "100%"), k=rng.randint(5, 10)))
    texts, labels, truth = [], [], []
    for k in range(160):
        kinds = [1] * 16 if k % 2 else [0] * 7 + [1] * 2 + [0] * 7
        texts.append("\n".join(plain() if y else junk() for y in kinds).encode())
        labels.append(k % 2)
        truth += kinds
    x, _, counts = line_crf.line_features(texts)
    model = line_crf.fit(x, counts, np.array(labels))
    p, _ = line_crf.forward_backward(line_crf._padded(x @ model.weights, counts), counts, model.step)
    right = (p[np.arange(p.shape[1]) < counts[:, None]] >= 0.5) == np.array(truth, bool)
    assert right.mean() > 0.97
    scores = line_crf.good_shares(texts, model)
    assert max(s for s, y in zip(scores, labels, strict=True) if not y) < line_crf.THRESHOLD < min(s for s, y in zip(scores, labels, strict=True) if y)


# decontamination


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), max_size=60))
def test_furthest_start_is_exact(item, text):
    d, end = dc.least_end(item, text)
    before = text[max(0, end - len(item) - d) : end]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, w in enumerate(a, 1):
            new = [i]
            for j, x in enumerate(b, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    want = max(n for n in range(len(before) + 1) if distance(item, before[len(before) - n :]) == d)
    assert dc.furthest_start(item, before, d) == want and brute_distance(item, text) == d


def altered(words, most, kind, rng):
    x = list(words)
    for at in sorted(rng.sample(range(len(x)), most), reverse=True):
        x[at : at + (kind != "insert")] = [] if kind == "delete" else [f"zz{rng.randrange(9999)}"]
    return x


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
@pytest.mark.parametrize(("n", "common"), [(5, 0.0), (9, 0.0), (10, 0.0), (15, 0.0), (15, 0.3), (19, 0.0), (29, 0.2)])
def test_recall_of_short_windows(n, common, kind):
    """At the largest distance allowed; common: the share of one word."""
    rng, cases = random.Random(n), 60
    items = [[("of" if rng.random() < common else f"w{rng.randrange(100_000)}") for _ in range(n)] for _ in range(cases)]
    index = dc.Index([(k, " ".join(x)) for k, x in enumerate(items)])
    pad = lambda: [f"p{rng.randrange(9999)}" for _ in range(30)]
    texts = [" ".join([*pad(), *altered(x, dc.allowed(n), kind, rng), *pad()]) for x in items]
    found = index.search(texts)
    assert sum(any(h[0] == k for h in hits) for k, hits in enumerate(found)) >= 0.9 * cases
    for k, hits in enumerate(found):
        for key, size, d, a, b in hits:
            words = texts[k].split()
            assert d == brute_distance(items[key], words) <= dc.allowed(size) and brute_distance(items[key], words[a:b]) == d


def test_search_finds_no_more_than_brute_force(docs, spark, data):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/sf0.001/benchmark.parquet").collect()]
    index = dc.Index(items)
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    word = {w: k for w, k in index.vocabulary.items()}
    want = set()
    for k, t in enumerate(texts):
        ids = [word.get(w, 0) for w in dc.words_of(t)]
        if len(ids) <= 250:
            want |= {(k, key) for key, item in index.items if dc.least_end(item, ids)[0] <= dc.allowed(len(item))}
    got = {(k, h[0]) for k, hits in enumerate(index.search(texts)) for h in hits if len(dc.words_of(texts[k])) <= 250}
    assert want and got <= want and len(got) >= 0.9 * len(want)


def test_short_items_match_exact_copies(spark):
    benchmark = spark.createDataFrame([("a", "too short"), ("b", "Paris"), ("c", None), ("d", "one two three four")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "it is too short here"), (2, "too very short"), (3, "In PARIS, one two three four"), (4, "one two four"), (5, None), (6, "")], "doc_id long, text string")
    got = dc.contamination(docs, benchmark, least_words=1).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["first_word"], r["end_word"]) for r in got) == [(1, "a", 0, 2, 4), (3, "b", 0, 1, 2), (3, "d", 0, 2, 6)]
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(docs, benchmark, least_words=1).collect()) == [2, 4, 5, 6]


# secrets


def test_spans_apart(spark):
    rng = random.Random(10)
    draw = lambda: [(s, 0, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
    cases = [(k, draw(), draw()) for k in range(300)]
    t = "array<struct<start:bigint,kind:int,end:bigint>>"
    got = spark.createDataFrame(cases, f"k int, a {t}, b {t}").select("k", se.apart(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        _, spans, others = cases[r["k"]]
        assert sorted(map(tuple, r["x"])) == sorted(x for x in spans if not any(x[0] < o[2] and o[0] < x[2] for o in others))


def test_running_totals(spark):
    rows = [([(7 * k) % 11 for k in range(n)],) for n in (0, 1, 2, 3, 7, 64, 100)]
    for r in spark.createDataFrame(rows, "v array<bigint>").select("v", se.running(F.col("v"), lambda x, y: x + y).alias("s"), se.running(F.col("v"), F.greatest).alias("m")).collect():
        assert r["s"] == list(itertools.accumulate(r["v"])) and r["m"] == list(itertools.accumulate(r["v"], max))


def brute_ratios(rows, smoothing=0.5, symbols=64):
    counts = {"random": {}, "ordinary": {}}
    for label, text in rows:
        for a, b in itertools.pairwise(map(ord, text)):
            if a * 128 + b < 16384 and b < 128 or a < 127 and 0 <= a * 128 + b <= 16383:
                counts[label][a * 128 + b] = counts[label].get(a * 128 + b, 0) + 1
    rows_of = {k: [sum(c.get(128 * a + b, 0) for b in range(128)) for a in range(128)] for k, c in counts.items()}
    p = lambda k, a, b: math.log((counts[k].get(128 * a + b, 0) + smoothing) / (rows_of[k][a] + smoothing * symbols))
    return [p("random", a, b) - p("ordinary", a, b) for a in range(128) for b in range(128)]


def brute_markov(text, ratios, odds):
    base, out = brute_spans(text), []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text):
        if sum(ratios[128 * ord(a) + ord(b)] for a, b in itertools.pairwise(m[0])) >= odds and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), m.end()))
    return out


def test_markov_spans_are_those_of_the_likelihood_ratio(spark, docs):
    strings = [(r["label"], r["string"]) for r in se.labelled_strings(docs).collect()]
    ratios = se.trained(docs)
    assert np.allclose(ratios, brute_ratios(strings), atol=1e-5)
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    texts = [" ".join(rng.choice(("the_ordinary_name_here", "token=abcdef" + "Qz9" * rng.randint(1, 5), "".join(rng.choices(letters, k=rng.randint(10, 40))), "0123456789abcdef01234567", "mot-à-mot" * 3)) for _ in range(30)) for _ in range(20)]
    texts += [r["text"] for r in docs.limit(100).collect()]
    for odds in (5.0, se.ODDS):
        got = se.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios, odds).collect()
        for r in got:
            found = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("markov")]
            assert found == brute_markov(texts[r["doc_id"]], ratios, odds)


def test_held_out_strings_are_told_apart(spark, docs):
    """Of distinct strings, a fifth by hash is held out. Strings of one case of letters are of no kind that was learned."""
    strings = se.labelled_strings(docs).distinct()
    part = F.pmod(F.xxhash64("string"), F.lit(5))
    ratios = se.transition_ratios(se.labelled_strings(docs).where(part != 0))
    rng = random.Random(13)
    single = spark.createDataFrame([("single", "".join(rng.choices(a, k=16 + k % 25))) for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for k in range(300)], "label string, string string")
    rated = strings.where((part == 0) & (F.length("string") >= 16)).union(single).select("label", (se.log_ratio(F.col("string"), ratios) >= se.ODDS).cast("int").alias("hit"))
    share = {r["label"]: r["x"] for r in rated.groupBy("label").agg(F.avg("hit").alias("x")).collect()}
    assert share["random"] >= 0.99 and share["single"] >= 0.9 and share["ordinary"] <= 0.005


def brute_redaction(text, spans, mark):
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + mark
        at = max(at, e)
    return out + text[at:]


def test_many_spans_in_one_text(spark, docs):
    ratios = se.trained(docs)
    text = "".join(f"é🤦 token=abcdef{k} password: secret=\nff0011{'ab' * 12} {'x' * (k % 1500)} " for k in range(1500))
    frame = spark.createDataFrame([(1, text), (2, "x" * 2048 + "token=abcdefgh"), (3, "token=abcdefgh" + "y" * 2034)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    redacted = {r["doc_id"]: r["text"] for r in se.redact_secrets(frame, ratios).collect()}
    for r in se.scan_secrets(frame, ratios).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x]
        base = [(s, e) for s, _, e in brute_spans(texts[r["doc_id"]])]
        assert set(base) <= set(spans)
        assert redacted[r["doc_id"]] == brute_redaction(texts[r["doc_id"]], spans, se.MARK)


def test_redaction_of_odd_rows(odd, empty):
    ratios = [0.0] * 16384
    got = se.redact_secrets(odd, ratios)
    assert got.columns == odd.columns and sorted(map(repr, got.collect())) == sorted(map(repr, odd.collect())) and se.redact_secrets(empty, ratios).count() == 0


# WARC


def test_roles_without_a_broadcast_are_the_same(spark):
    pages = spark.createDataFrame([(k, "u", f"page {k % 7}") for k in range(40)] + [(None, "u", "page 1"), (3, "u", "page 3"), (50, "u", None)], "page_id long, url string, html string")
    one, two = (sorted(map(repr, warc.with_roles(pages, broadcast_digests=n).collect())) for n in (0, 1000))
    assert one == two and len(one) == 43


def test_large_members_and_small_splits(spark, tmp_path):
    rng = random.Random(17)
    texts = [bytes(rng.randrange(256) for _ in range(n)).decode("latin-1") for n in (3_000_000, 10, 0, 200_000)] + ["x" * 5_000_000] + [f"small {k}" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u")).repartition(2)
    manifest = warc.archives(warc.with_roles(pages), f"file://{tmp_path}/w")
    for split in (100_000, 1 << 30):
        got = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, manifest, split).collect()}
        assert len(got) == len(texts) and all(bytes(got[k]).decode() == t for k, t in enumerate(texts))


# packing


def test_padding_is_little(spark, data):
    rows = packing.pack(spark.read.parquet(f"{data}/sf0.01/documents.parquet")).collect()
    used, where = sum(r["length"] for r in rows), {r["sequence_id"] for r in rows}
    assert 1 - used / (packing.WINDOW * len(where)) < 0.003
    full = [r for r in rows if r["length"] == packing.WINDOW]
    assert full and all(r["sequence_id"] % 2 and r["offset"] == 0 for r in full) and not any(r["sequence_id"] % 2 for r in rows if r["length"] < packing.WINDOW)


def test_groups_are_even_whatever_repeats(spark):
    same = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = packing.pack(same.repartition(2), group_rows=500).groupBy((F.col("sequence_id") / 2**33).cast("long").alias("g")).count().collect()
    assert sum(r["count"] for r in rows) == 6000 and len(rows) == 12 and max(r["count"] for r in rows) < 800
    long = spark.createDataFrame([(1, "word " * 500_000), (2, "short")], "doc_id long, text string")
    got = packing.pack(long, group_rows=1).collect()
    assert len({r["sequence_id"] for r in got if r["length"] < packing.WINDOW}) <= 2 and sum(r["length"] == packing.WINDOW for r in got) == len(got) - 2
    assert not re.search(r"Exchange", packing.pack(long)._jdf.queryExecution().executedPlan().toString().split("Union")[1].split("MapInArrow")[0])

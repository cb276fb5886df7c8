"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Candidates are runs of 16 or more characters of [A-Za-z0-9+/_=-]; shorter ones are left to the patterns. Two first-order Markov models, of random strings and of ordinary identifiers, are estimated from labelled samples; a candidate
is a secret if its log-likelihood ratio is at least `odds` nats. Spans of the patterns (kinds assign, access, hex) always
stay; a markov span that overlaps one of them is left out.

Patterns are matched leftmost and without overlap, by kind; a match that is too short is dropped but keeps its place.
Positions are code points, ends exclusive. Everything is an expression over one row, so nothing is shuffled and memory
is that of a row; a row's time grows with its matches' number times its logarithm. Only the models' transition counts, at most 2 x 128 x 128 rows, come to the driver.

Defined cases: a null text is empty and has no span; null ids are carried; repeated rows give repeated results; an
empty table gives an empty result (the ordinary model then rests on its smoothing and the made identifiers); other
columns are ignored by the scan and kept by redact_secrets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, the group whose length counts and its least length, by kind, in the order of ties.
PATTERNS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a text must hold for the pattern to have a match that counts; cheaper to look for.
HINTS = {
    "assign": PATTERNS["assign"][0],
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KINDS = (*PATTERNS, "markov")
#: Labelled strings of either kind that are made or sampled for the models, and documents sampled for words.
SAMPLE_STRINGS, SAMPLE_DOCS = 3000, 2000
#: Nats. From 15 on no fewer of the held-out ordinary strings are taken for random ones; 5 more are a margin for other texts
#: (the README has the rates).
ODDS = 20.0
MARK = "[SECRET]"
#: Code points of the parts that a text is cut into to take pieces out of it.
PART = 1024
#: Words of paths and code, which prose has not.
CODE = (
    "api app args array assets async auth await backend base bin bool boolean bucket buffer build bytes cache callback char check class client cluster cmd com common component config console const container content context controller core "
    "css data database debug default delete dest dev dict dir dist docs domain double driver dst edu email enum env error event example exec export fetch file filter float folder format frontend func function get git github handler hash header "
    "home host html http https id image img import include index info init input instance int integer interface internal io java javascript js json key kernel lib library link linux list local log logger login main manager map master message "
    "method mod model module mount net node npm null number object opt org output package page param parse password path payload php plugin pool port project property protected proxy public pull push py python query queue readme regex render repo "
    "request require resource response result return root router run schema script select self server service session set settings shared socket source spec sql src static status store stream string struct style sync sys system table target "
    "task temp template test tests thread timeout tmp token tool tree txt type update upload url user usr utils validate value var vector version view void web widget window workspace wrapper www xml yaml zip"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Distances of the passes of running(): their sum exceeds any array's length.
_STEPS = [1 << k for k in range(31)]


def running(values: Column, join: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """The first member, the first two joined, the first three, ...: log2(n) passes over an array of longs, as an array that
    is extended member by member would be copied each time. start: what joins with anything to that."""

    def doubled(acc: Column, step: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(start).cast("long"), step), F.slice(acc, 1, F.size(acc) - step))
        return F.zip_with(acc, before, lambda x, y: join(x, y))

    return let(values, lambda v: F.aggregate(F.filter(F.array(*map(F.lit, _STEPS)), lambda s: s < F.size(v)), v, doubled))


def found_spans(text: Column, kind: int, pattern: str, group: int, least: int, hint: str) -> Column:
    """array<struct<start, kind, end, value>> of the matches that count."""
    empty = F.expr("array_repeat(named_struct('start', 0L, 'kind', 0, 'end', 0L, 'value', ''), 0)")
    p = F.lit(pattern)

    def placed(s: Column) -> Column:
        n = F.size(s["whole"])
        ends = running(F.zip_with(F.slice(s["gaps"], 1, n), s["whole"], lambda g, w: (F.length(g) + F.length(w)).cast("long")), lambda x, y: x + y)
        return let(F.struct(s["whole"].alias("whole"), s["value"].alias("value"), ends.alias("ends")), spans)

    def spans(s: Column) -> Column:
        def span(whole: Column, i: Column) -> Column:
            end = F.get(s["ends"], i)
            return F.struct((end - F.length(whole)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(s["value"], i).alias("value"))

        return F.filter(F.transform(s["whole"], span), lambda x: F.length(x["value"]) >= least)

    got = let(F.regexp_extract_all(text, p, F.lit(0)), lambda whole: F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), (F.regexp_extract_all(text, p, F.lit(group)) if group else whole).alias("value")))
    return F.when(text.rlike(hint), let(got, placed)).otherwise(empty)


def apart(spans: Column, others: Column) -> Column:
    """Those of spans that overlap none of others. In one order of the others' starts and the spans' ends, a span overlaps
    one of the others before it if the furthest end of these lies beyond the span's start."""
    none = F.lit(0).cast("long")
    points = F.array_sort(F.concat(
        F.transform(others, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("other"), x["end"].alias("end"), x.alias("span"))),
        F.transform(spans, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("other"), none.alias("end"), x.alias("span"))),
    ))

    def kept(p: Column) -> Column:
        furthest = running(F.transform(p, lambda x: x["end"]), F.greatest)
        clear = F.zip_with(p, furthest, lambda x, f: F.struct(((x["other"] == 0) & (f <= x["span"]["start"])).alias("clear"), x["span"].alias("span")))
        return F.transform(F.filter(clear, lambda x: x["clear"]), lambda x: x["span"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(points, kept))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c))


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strings: int = SAMPLE_STRINGS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """label ('random' or 'ordinary') and string. Random: hexadecimal, base64 and upper-case digests of numbers.
    Ordinary: all words of documents (about sample_docs of them, chosen by a hash of the id) alone and joined as
    identifiers, and dates, counters and paths made of them; words of code joined so; and ruled lines."""
    spark = docs.sparkSession
    n = F.col("id").cast("string")
    sha = F.sha2(n, 256)
    b64 = F.regexp_replace(F.base64(F.unhex(sha)), "=", "")
    made = spark.range(strings).select(
        F.lit("random").alias("label"),
        F.explode(F.array(F.substring(sha, 1, 40), b64, F.substring(F.regexp_replace(b64, "[+/]", ""), 1, 32), F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.sha1(n))), "[^A-Za-z0-9]", ""), 1, 20))))).alias("string"),
    )
    rules = [F.repeat(F.lit(c), 80) for c in "-_=+/"] + [F.repeat(F.lit(f"+{c * 9}"), 8) for c in "-="] + [F.repeat(F.lit("-="), 40)]
    ruled = spark.range(strings // 10).select(F.lit("ordinary").alias("label"), F.explode(F.array(*rules)).alias("string"))
    step = max(1, docs.count() // max(sample_docs, 1))
    words = (
        docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(step)) == 0)
        .select(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(r"(?<![^\x20\n])([A-Za-z]{2,24})(?![^\x20\n])"), F.lit(1)).alias("w"))
        .where(F.size("w") >= 3)
    )
    def joined(t: Column) -> Column:
        i, a, b, c = t["i"], t["a"], t["b"], t["c"]
        return F.array(a, F.concat_ws("_", a, b, c), F.concat(F.lower(a), F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, F.lit("2024-01-15")), F.concat_ws("/", a, b, c), F.upper(F.concat_ws("_", a, b)), F.concat(a, i.cast("string")), F.concat_ws("_", b, F.lit("v2"), i.cast("string")), F.concat(F.lit("0000"), (i * 1237).cast("string"), F.lit("00")))

    three = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(3)), lambda i: F.struct(i.alias("i"), *(F.get("w", i + k).alias(n) for k, n in enumerate("abc"))))).alias("t"))
    ordinary = three.select(F.lit("ordinary").alias("label"), F.explode(joined(F.col("t"))).alias("string"))
    code = [sep.join(CODE[(i * k + j) % len(CODE)] for j in range(4)) for i in range(len(CODE)) for k, sep in ((1, "/"), (3, "-"), (7, "_"))]
    coded = spark.createDataFrame([(c,) for c in code], "c string").select(F.lit("ordinary").alias("label"), F.explode(F.array_repeat(F.concat(F.lit("/"), "c"), max(1, strings // 60))).alias("string"))
    return made.union(ordinary).union(ruled).union(coded)


def transition_ratios(strings: DataFrame, smoothing: float = 0.5, symbols: int = 64) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at 128 * a + b."""
    codes = strings.select("label", _codes(F.col("string")).alias("c")).where(F.size("c") > 1)
    pairs = codes.select("label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * 128 + b)).alias("pair"))
    counts: dict[str, dict[int, int]] = {"random": {}, "ordinary": {}}
    for r in pairs.where("pair between 0 and 16383").groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] = r["count"]
    rows = {k: [sum(c.get(128 * a + b, 0) for b in range(128)) for a in range(128)] for k, c in counts.items()}

    def log_p(kind: str, a: int, b: int) -> float:
        return math.log((counts[kind].get(128 * a + b, 0) + smoothing) / (rows[kind][a] + smoothing * symbols))

    return [round(log_p("random", a, b) - log_p("ordinary", a, b), 6) for a in range(128) for b in range(128)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return let(F.struct(_codes(token).alias("c"), table.alias("t")), lambda s: F.aggregate(F.zip_with(s["c"], F.slice(s["c"], 2, F.greatest(F.size(s["c"]) - 1, F.lit(0))), lambda a, b: F.coalesce(F.get(s["t"], a * 128 + b), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y))


def secret_spans(text: Column, ratios: list[float], odds: float) -> Column:
    """struct<base, spans>: arrays of struct<start, kind, end>, in order."""
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.concat(*(found_spans(text, k, p, g, n, HINTS[kind]) for k, (kind, (p, g, n)) in enumerate(PATTERNS.items())))
    more = F.filter(found_spans(text, len(PATTERNS), CANDIDATE, 0, 16, CANDIDATE), lambda s: log_ratio(s["value"], ratios) >= odds)

    def joined(s: Column) -> Column:
        return F.struct(F.array_sort(s["base"]).alias("base"), F.array_sort(F.concat(s["base"], apart(s["more"], s["base"]))).alias("spans"))

    return let(F.struct(short(base).alias("base"), short(more).alias("more")), joined)


def as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    return transition_ratios(labelled_strings(docs, id_col, text_col))


def scan_secrets(docs: DataFrame, ratios: list[float] | None = None, odds: float = ODDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans."""
    ratios = ratios or trained(docs, id_col, text_col)
    found = docs.select(F.col(f"`{id_col}`").alias("_id"), secret_spans(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), ratios, odds).alias("_s"))

    def count(k: int) -> Column:
        return F.size(F.filter("_s.base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(as_text(F.col("_s.base")), 256).alias("base_sha256"), as_text(F.col("_s.spans")).alias("spans"))


def redact_secrets(docs: DataFrame, ratios: list[float] | None = None, odds: float = ODDS, id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """The documents with every secret span replaced by mark; texts without one, and null texts, are as they were."""
    ratios = ratios or trained(docs, id_col, text_col)
    text = F.col(f"`{text_col}`")

    def piece(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PART)
        return F.substr(F.array_join(F.slice(parts, (first + 1).cast("int"), (F.floor(end / PART) - first + 1).cast("int")), ""), (start - first * PART + 1).cast("int"), (end - start).cast("int"))

    def cut(spans: Column) -> Column:
        def joined(s: Column) -> Column:
            def before(span: Column, i: Column) -> Column:
                at = F.coalesce(F.get(s["ends"], i - 1), F.lit(0).cast("long"))
                return F.when(span["start"] >= at, F.concat(piece(s["parts"], at, span["start"]), F.lit(mark))).otherwise("")

            rest = piece(s["parts"], F.element_at(s["ends"], -1), F.length(text).cast("long"))
            return F.concat(F.array_join(F.transform(s["spans"], before), ""), rest)

        parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
        return let(F.struct(spans.alias("spans"), parts.alias("parts"), running(F.transform(spans, lambda x: x["end"]), F.greatest).alias("ends")), joined)

    new = let(secret_spans(F.coalesce(text, F.lit("")), ratios, odds), lambda s: F.when(F.size(s["spans"]) > 0, cut(s["spans"])).otherwise(text))
    return docs.withColumn(text_col, F.when(text.isNotNull(), new))

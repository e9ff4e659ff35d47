"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

``fit`` counts character pairs of labelled samples for both classes; the model is the table of
log-likelihood ratios of one character after another, of fixed size (the alphabet squared), moved
so that the cut that held-out samples of both classes call for is at ``min_per_char``.
``scan`` adds the ratios along each long run of identifier characters and reports runs that are
likelier random. Patterns and models are column expressions over one row: nothing is shuffled
and no row is too hot.

Defined results: null texts count as empty and have no spans. Offsets are code points, ends
exclusive. Matches of one kind don't overlap; kinds may overlap one another, but a run that
overlaps a pattern's match is not reported again. Repeated rows are scanned alike. Columns
beside doc_id and text are not read by ``scan`` and pass through ``redact``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrove.functions.bind import bind
from pagetrove.session import write_scratch

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "".join(map(chr, range(48, 58))) + "".join(map(chr, range(65, 91))) + "".join(map(chr, range(97, 123))) + "+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
SIZE = len(ALPHABET) + 1  # 0 stands for the start


@dataclass(frozen=True)
class ScanConfig:
    smoothing: float = 0.5       # added to the count of each single character
    prior: float = 5.0           # weight of single characters against pairs
    min_ratio: float = 8.0       # log-likelihood ratio a run must reach
    min_per_char: float = 0.4    # and its mean per character, where the held-out cut is put
    marker: str = "[SECRET]"


def codes(text: Column) -> Column:
    """Numbers of the characters in the alphabet; the text has no others."""
    table = ["0"] * 128
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = str(i + 1)
    lookup = F.split(F.lit(",".join(table)), ",").cast("array<int>")
    return F.transform(F.split(text, ""), lambda c: F.get(lookup, F.ascii(c)))


def made_ordinary(words: Column, key: Column) -> Column:
    """Identifiers, paths, dates, numbers and rules, put together from six words."""
    digest = F.sha2(key, 256)

    def n(i, below):
        return F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % below

    def w(*numbers, style=F.lower):
        return [style(F.get(words, F.lit(i))) for i in numbers]

    year, month, day = (n(0, 50) + 1990).cast("string"), F.lpad((n(1, 12) + 1).cast("string"), 2, "0"), F.lpad((n(2, 28) + 1).cast("string"), 2, "0")
    slash, dash, line, equals = map(F.lit, "/-_=")
    rules = F.array(*map(F.lit, "+/_=-"))
    return F.array(
        F.concat_ws("_", *w(0, 1), year, *w(2), month),
        F.concat(slash, F.concat_ws("/", *w(0)), slash, F.concat_ws("-", *w(1, 2)), slash, *w(3)),
        F.concat(slash, F.concat_ws("/", year, month, day), slash, F.concat_ws("-", *w(4, 5, 0))),
        F.concat_ws("/", *w(0, 1, 2, 3)), F.concat_ws("-", year, month, day, *w(0)),
        F.concat(*w(0), *w(1, 2, 3, style=F.initcap)), F.concat(*w(4, 5, style=F.initcap), n(3, 100).cast("string")),
        F.concat_ws("_", *w(0, 1, 2, style=F.upper)), F.concat(*w(0), equals, *w(1), line, n(5, 1000).cast("string")),
        F.concat(*[n(i, 10).cast("string") for i in range(16)]), F.lit("1234567890" * 2),
        F.repeat(F.get(rules, n(4, 5)), 20))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings (text, random, times). Ordinary are the runs of 8 characters or more in all
    documents, but for what base patterns cover, and from each document a dozen strings made of its
    first words; random are digests in the shapes that keys have (hexadecimal, base 64, capitals and digits)."""
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    found = docs.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{8,}"), F.lit(0))).alias("text"), F.lit(False).alias("random"))
    key = F.concat(F.lit("sample|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all(F.substring(text, 1, 1000), F.lit(r"[A-Za-z]{3,}"), F.lit(0))
    made = docs.select(words.alias("words"), key.alias("key")).filter(F.size("words") >= 6).select(
        F.explode(made_ordinary(F.col("words"), F.col("key"))).alias("text"), F.lit(False).alias("random"))
    digest = F.sha2(key, 256)
    shapes = F.array(
        F.md5(key.cast("binary")), F.base64(F.unhex(digest)),
        F.concat(F.conv(F.substring(digest, 1, 12), 16, 36), F.conv(F.substring(digest, 13, 12), 16, 36)))
    drawn = docs.select(F.explode(shapes).alias("text"), F.lit(True).alias("random"))
    return found.unionByName(made).unionByName(drawn).groupBy("text", "random").agg(F.count("*").alias("times"))


def fit(labelled: DataFrame, config: ScanConfig = ScanConfig()) -> list[float]:
    """The table of log P(next | random) - log P(next | ordinary), row by previous character, from
    four fifths of the strings (of the times of a frequent one); the others say where to cut.

    At most 2 x 68 x 68 counts reach the driver. Without samples of a class the ratio says nothing (0).
    """
    times = F.col("times") if "times" in labelled.columns else F.lit(1)
    clean = labelled.filter(F.col("random").isNotNull()).select(
        "random", F.regexp_replace("text", r"[^A-Za-z0-9+/_=-]", "").alias("text"), times.cast("long").alias("times"))
    held_out = F.when(F.col("times") >= 5, F.floor(F.col("times") / 5)).when(F.pmod(F.xxhash64("text"), F.lit(5)) == 0, F.col("times")).otherwise(0)
    clean = write_scratch(clean.withColumn("held_out", held_out).withColumn("times", F.col("times") - F.col("held_out")), "secret-samples")
    coded = clean.filter("times > 0").withColumn("c", F.concat(F.array(F.lit(0)), codes(F.col("text"))))
    pairs = F.transform(F.slice("c", 1, F.size("c") - 1), lambda a, i: a * SIZE + F.get("c", i + 1))
    counts = coded.select("random", "times", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.sum("times").alias("n")).collect()
    n = {r: [[0.0] * SIZE for _ in range(SIZE)] for r in (False, True)}
    for row in counts:
        n[row["random"]][row["pair"] // SIZE][row["pair"] % SIZE] += row["n"]
    logs = {}
    for r, lines in n.items():  # pairs are smoothed by single characters, which are smoothed evenly
        single = [sum(column) + config.smoothing for column in zip(*lines)]
        share = [x / sum(single) for x in single]
        logs[r] = [math.log((x + config.prior * p) / (sum(line) + config.prior)) for line in lines for x, p in zip(line, share)]
    table = [a - b for a, b in zip(logs[True], logs[False])]
    cut = best_cut(clean.filter((F.col("held_out") > 0) & (F.char_length("text") >= 16)), table)
    return table if cut is None else [x - cut + config.min_per_char for x in table]


def best_cut(held_out: DataFrame, table: list[float], steps: int = 50) -> float | None:
    """The mean ratio a character that parts the two kinds with the least shares of both on the wrong
    side, the middle one of equals; None without strings of both."""
    mean = ratio(F.col("text"), table) / F.char_length("text")
    rows = held_out.groupBy("random", F.floor(mean * steps).alias("step")).count().collect()
    n = {r: {x["step"]: x["count"] for x in rows if x["random"] == r} for r in (False, True)}
    if not n[False] or not n[True]:
        return None
    wrong = {}
    for at in range(min(min(x) for x in n.values()), max(max(x) for x in n.values()) + 2):
        wrong[at] = (sum(k for s, k in n[False].items() if s >= at) / sum(n[False].values())
                     + sum(k for s, k in n[True].items() if s < at) / sum(n[True].values()))
    best = [at for at, x in wrong.items() if x <= min(wrong.values()) + 1e-12]
    return best[len(best) // 2] / steps


def ratio(text: Column, model: list[float]) -> Column:
    """The sum of the model's ratios along the text."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        codes(text), start,
        lambda s, c: F.struct(c.alias("at"), (s["sum"] + F.get(table, s["at"] * SIZE + c)).alias("sum")),
        lambda s: s["sum"])


def running(sizes: Column) -> Column:
    """Sums of what is ahead of each element, in blocks of about the root of the length."""
    def sums(array):
        return F.aggregate(array, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def blocked(side):
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / side).cast("int") - 1),
                            lambda i: sums(F.slice(sizes, i * side + 1, side)))
        return bind(parts, lambda p: bind(
            sums(F.transform(p, lambda x: F.element_at(x, -1))),
            lambda offset: F.flatten(F.transform(
                p, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get(offset, i))))))

    side = F.ceil(F.sqrt(F.size(sizes))).cast("int")
    return F.when(F.size(sizes) > 0, blocked(F.greatest(side, F.lit(1)))).otherwise(F.array().cast("array<int>"))


SPANS = "array<struct<start: int, kind: int, end: int, text: string>>"


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of the pattern's matches, from the lengths of what lies between them."""
    p = F.lit(pattern)

    def built(found):
        gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
        step = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.char_length(m))
        return bind(running(step), lambda ahead: bind(gaps, lambda gap: F.transform(found, lambda m, i: F.struct(
            (F.get(ahead, i) + F.get(gap, i)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            (F.get(ahead, i) + F.get(gap, i) + F.char_length(m)).alias("end"), m.alias("text")))))

    spans = bind(F.regexp_extract_all(text, p, F.lit(0)), built)
    if keep is not None:
        spans = F.filter(spans, keep)
    return F.when(F.rlike(text, p), spans).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    long_value = rf"""{ASSIGN[:-2]}{{{ASSIGN_MIN},}})$"""
    return F.array_sort(F.concat(
        matches(text, ASSIGN, "assign", lambda s: F.rlike(s["text"], F.lit("^" + long_value))),
        matches(text, ACCESS, "access"), matches(text, HEX, "hex")))


def markov_spans(text: Column, base: Column, model: list[float], config: ScanConfig) -> Column:
    def likely(s):
        return bind(ratio(s["text"], model), lambda r: (r >= config.min_ratio) & (r >= config.min_per_char * F.char_length(s["text"])))

    return matches(text, RUN, "markov", lambda s: ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & likely(s))


def scan_column(text: Column, model: list[float], config: ScanConfig = ScanConfig()) -> tuple[Column, Column]:
    """(base, all): spans as arrays of (start, kind, end, text), by start, then kind."""
    base = base_spans(text)
    return base, bind(base, lambda b: F.array_sort(F.concat(b, markov_spans(text, b, model, config))))


def scan(docs: DataFrame, model: list[float], config: ScanConfig = ScanConfig()) -> DataFrame:
    """(doc_id, base, spans) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return found.withColumn(
        "spans", F.array_sort(F.concat("base", markov_spans(F.col("text"), F.col("base"), model, config)))).drop("text")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, marker: str) -> Column:
    """The text with each run of covered characters replaced by the marker."""
    def widen(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] > s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(
            F.concat(acc, F.array(own)))

    runs = F.aggregate(spans, F.array().cast("array<struct<start: int, end: int>>"), widen)
    return bind(runs, lambda r: F.array_join(F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["end"])),
        F.concat(F.transform(r, lambda x: x["start"]), F.array(F.char_length(text))),
        lambda a, b: F.substring(text, a + 1, b - a)), marker))


def redact(docs: DataFrame, model: list[float], config: ScanConfig = ScanConfig()) -> DataFrame:
    """The documents with their secrets replaced; n_chars, where there is one, follows the text."""
    spans = scan_column(docs["text"], model, config)[1]
    text = F.when(docs["text"].isNotNull(), bind(spans, lambda s: F.when(
        F.size(s) > 0, redacted(docs["text"], s, config.marker)).otherwise(docs["text"])))
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out

"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words, a word's weight being how often it occurs. For each of D
samples, every word draws r and c (gamma with shape 2) and b (uniform) from a hash of the word and
the sample's number; with t = floor(ln(weight) / r + b) its value is c * exp(-r * (t - b + 1)),
and the sample keeps the least value (Ioffe's improved consistent weighted sampling). The least
value is the same number in two texts if and only if the same word and t gave it, so the values
themselves are the signature: two texts agree in a sample with a probability equal to their
generalised Jaccard similarity, sum of lesser over sum of greater weights.

All of it is column arithmetic. Documents are dealt once, into buckets of ids; words are counted and
least values found where their text lies, and D numbers per text leave it.

Defined results: null and empty texts have no words; they agree with one another in all samples
and with other texts in none. Repeated rows are fingerprinted one by one. Only doc_id and text
are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrove.session import write_scratch

from .common import SPACE

SAMPLES = 32
STEPS = 1 << 12


def gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, whose share below x is 1 - (1 + x) exp(-x)."""
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(200):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def tables() -> tuple[Column, Column, Column]:
    """Gamma variates by 12 random bits, their logarithms, and the logarithms of those whose 12
    bits are 0 by 12 more bits. Looking them up spares three slow functions per word and sample."""
    u = (np.arange(STEPS) + 0.5) / STEPS
    values = gamma_quantiles(u), np.log(gamma_quantiles(u)), np.log(gamma_quantiles(u / STEPS))
    return tuple(F.split(F.lit(",".join(map(repr, v.tolist()))), ",").cast("array<double>") for v in values)


def sample_value(word: Column, log_weight: Column, number: Column, lookup: tuple[Column, Column, Column]) -> Column:
    """The logarithm of a word's value in one sample. The bits of one hash give r, c and b."""
    gamma, log_gamma, log_least = lookup
    bits = F.xxhash64(word, number)
    part = lambda shift, width: F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    r = F.get(gamma, part(0, 12))
    log_c = F.when(part(12, 12) == 0, F.get(log_least, part(24, 12))).otherwise(F.get(log_gamma, part(12, 12)))
    b = (part(36, 28).cast("double") + 0.5) * (1.0 / (1 << 28))
    return log_c - r * (F.floor(log_weight / r + b) - b + 1.0)


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """The keys, which must tell rows apart, and ``signature``: array<double>, null without words.

    Words are counted, and their least values found, by aggregates over the keys. Where the rows
    are dealt by some of the keys already, none of this is shuffled.
    """
    word = F.explode(F.split("text", SPACE)).alias("word")
    words = texts.select(*keys, word).select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("word"))
    words = words.groupBy(*keys, "word").agg(F.count("*").alias("weight"))
    words = words.select(*keys, "word", F.log(F.col("weight").cast("double")).alias("log_weight"))
    # Two samples at a time: an aggregate of all samples is too long a method to be compiled.
    spread = words.withColumn("pair", F.explode(F.array(*[F.lit(i) for i in range(samples // 2)])))
    lookup = tables()
    least = [F.min(F.when(F.col("word").isNotNull(), sample_value(F.col("word"), F.col("log_weight"), F.col("pair") * 2 + i, lookup)))
             .alias(f"s{i}") for i in (0, 1)]
    pairs = spread.groupBy(*keys, "pair").agg(*least)
    signature = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pair", "s0", "s1"))), lambda p: F.array(p["s0"], p["s1"])))
    found = pairs.groupBy(*keys).agg(signature.alias("signature"), F.max("s0").alias("any"))
    return found.select(*keys, F.when(F.col("any").isNotNull(), F.col("signature")).alias("signature"))


def fingerprint(signature: Column) -> Column:
    """Eight hexadecimal digits of each sample's value."""
    return F.coalesce(F.array_join(F.transform(
        signature, lambda v: F.lpad(F.hex(F.pmod(F.xxhash64(v), F.lit(1 << 32))), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree; two empty ones agree in all."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8))))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = write_scratch(rows, "fingerprint-rows")
    found = signatures(rows.repartition("row"), ["row"], samples)
    return rows.select("row", "doc_id").join(found, "row", "left").select("doc_id", fingerprint(F.col("signature")).alias("fingerprint"))


def next_to(docs: DataFrame) -> DataFrame:
    """Each document with the next one's text, by ascending id: (bucket, place, doc_id, text, next_text, copy).

    Ids are cut into buckets of equal width, four times as many as shuffle partitions, so the order
    is found bucket by bucket. The first document of each bucket, of which there are as many as
    buckets, is also put at the end of the bucket before it (``copy``), and that of all at the end
    of the last. Null ids come first. Rows of one id are ordered by their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // count))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.floor((F.col("doc_id").cast("double") - float(low or 0)) / float(width))).cast("long")
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("bucket", bucket).groupBy("bucket").agg(
        F.min("doc_id").alias("first")).orderBy("bucket").collect()
    # One row per bucket: where its first document is also put.
    before = [(r.first if r.first is not None else 0, r.first is None, firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    ends = spark.createDataFrame(before, "first long, of_null boolean, also long")
    rows = rows.withColumn("bucket", bucket)
    meets = F.when(F.col("of_null"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("first"))
    key = rows.join(F.broadcast(ends), (F.coalesce("doc_id", F.lit(0)) == F.col("first")) & meets, "left")
    places = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"), F.lit(0).alias("turn")),
        F.struct(F.col("also").alias("bucket"), F.lit(True).alias("copy"), F.lit(1).alias("turn")))
    key = key.select("doc_id", "text", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())).alias("p"))
    key = key.select("p.bucket", "p.copy", "p.turn", "doc_id", "text")
    order = W.partitionBy("bucket").orderBy("turn", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return key.select(
        "bucket", F.row_number().over(order).alias("place"), "copy", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike text, edit and next text are.

    The edited text has the last half of the text (rounded down) replaced by the first as many
    code points, or all, of the next document.
    """
    placed = next_to(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.col("text")), F.lit(1), half))
    texts = placed.select("bucket", "place", "copy", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), edited.alias("text")))).alias("t"))
    texts = texts.filter(~F.col("copy") | (F.col("t.which") == 0)).select("bucket", "place", "t.which", "t.text")
    prints = signatures(texts, ["bucket", "place", "which"], samples).withColumn("print", fingerprint(F.col("signature")))
    prints = prints.groupBy("bucket", "place").agg(
        F.max(F.when(F.col("which") == 0, F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("print"))).alias("edited_fingerprint"))
    known = placed.select("bucket", "place", "copy", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    pair = known.join(prints, ["bucket", "place"])
    following = F.lead("fingerprint").over(W.partitionBy("bucket").orderBy("place"))
    out = pair.withColumn("next", following).filter(~F.col("copy"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next", F.col("fingerprint")), samples).alias("near_next"))

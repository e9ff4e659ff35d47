"""Mixing sources to target weights by weighted sampling with exponential keys.

Each document draws one exponential key, scaled by its quality weight: the smaller the key, the
earlier it is taken (Efraimidis and Spirakis). A source's target is met with complete epochs
first; the rest is a prefix of its documents in key order, found by a prefix sum of their sizes.

The keys depend on the document id alone, so reruns agree. The only rows that meet in one task
are one per source, and one per source and range; documents are dealt by ranges of (source,
key), which split a source of any size.

Defined results: a null text has size 0; a null source is a source of its own, the last one; a
null id draws the key of the empty id. Rows of one id share a key and are taken or left together
when the prefix ends among them. Sources without words, and empty tables, have target 0. Only the
columns named by the arguments are read; others pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetrove.session import write_scratch

from .common import WORD

SYMBOLS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.1 (nothing but symbols) to 1 (no symbols, or no text)."""
    n, kept = F.char_length(text), F.char_length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.9) * (n - kept) / F.when(n > 0, n), F.lit(1.0))


def draw(doc_id: Column, weight: Column, seed: str) -> Column:
    """An exponential variate of rate ``weight`` from the keyed digest of the id."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Shares of the total size by source: (source, source_size, target).

    ``sizes`` has (source, size). Sources in code point order, null last, weigh ``weights`` in
    turn; a target stops at ``cap`` times its source's size, and what is over is shared anew by
    weight. That is the level at which ``min(cap * size, level * weight)`` sums to the total:
    sources reach their cap in the order of cap * size / weight, so the level follows from one
    running sum over the sources.
    """
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    source = source.select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("w"),
        (F.col("source_size") * cap).alias("most"))
    by_level = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    room = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    source = source.withColumn("full", F.col("w") * room > F.col("most") * weight)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0))
    spread = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return source.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("most").cast("double"))
        .otherwise((F.col("w") * left).cast("double") / spread).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """What each source gives: (source, source_size, target, epochs, cut).

    ``sized`` has (doc_id, source, size, key). ``epochs`` is how often all its documents are
    taken; those up to ``cut``, a struct of key and id, are taken once more.
    """
    goal = targets(sized, weights, cap)
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    goal = goal.withColumn("epochs", epochs.cast("long"))
    goal = write_scratch(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-goal")

    ranges = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized.filter("size > 0").repartitionByRange(ranges, "source", "key", "doc_id")
    dealt = write_scratch(dealt.withColumn("part", F.spark_partition_id()), "mix-ranges")
    sums = dealt.groupBy("part", "source").agg(F.sum("size").alias("of_part"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("of_part").over(ahead), F.lit(0)))
    # The prefix ends in one range of a source; only that range's rows are put in order.
    ends = sums.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    ends = ends.filter((F.col("ahead") <= F.col("rest")) & (F.col("ahead") + F.col("of_part") > F.col("rest")))
    ends = ends.select(F.col("part").alias("end_part"), "of", "ahead", "rest", "of_part")
    last = dealt.join(ends, (F.col("part") == F.col("end_part")) & F.col("source").eqNullSafe(F.col("of")))
    before = F.sum("size").over(
        W.partitionBy("part", "source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    taken = last.withColumn("before", F.col("ahead") + F.coalesce(before, F.lit(0)))
    taken = taken.filter((F.col("rest") - F.col("before")) * 2 >= F.col("size"))
    inside = taken.groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    # A range that ends before anything of it is taken leaves the last row of the range ahead.
    whole = dealt.groupBy("part", "source").agg(F.max(F.struct("key", "doc_id")).alias("edge"))
    whole = whole.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") < F.col("end_part")))
    whole = whole.groupBy("source").agg(F.max("edge").alias("cut"))
    cuts = inside.unionByName(whole).groupBy(F.col("source").alias("of")).agg(F.max("cut").alias("cut"))
    done = goal.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    return write_scratch(done.select("source", "source_size", "target", "epochs", "cut"), "mix-plan")


def measure(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key"))


def copies(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """``sized`` with its source's figures and ``copies``, how often the mix takes the document.

    The shares are one row per source; Spark sends them to all tasks while their file is small
    and splits a hot source otherwise.
    """
    shares = shares.withColumnRenamed("source", "of")
    both = sized.join(shares, F.col("source").eqNullSafe(F.col("of")), "left")
    again = (F.struct("key", "doc_id") <= F.col("cut")).cast("long")
    return both.withColumn("copies", F.col("epochs") + F.coalesce(again, F.lit(0))).drop("of", "cut", "epochs")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    sized = write_scratch(measure(docs, seed), "mix-sizes")
    out = copies(sized, plan(sized, weights, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Texts don't move: the plan is made from (id, source, size, key), and each document meets its
    source's row of it. Documents without words weigh nothing and stay, once.
    """
    sized = write_scratch(measure(docs, seed), "mix-sizes")
    shares = plan(sized, weights, cap)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    kept = copies(docs.select(
        row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key")), shares)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    return kept.select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")

"""First-wins deduplication on narrow key rows, and key lookups against a store.

Rows are reduced to their keys before any shuffle, and every grouping is a ``min`` with a
partial aggregate in front of it: a key that a third of all rows share reaches the shuffle
as one row per map task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.session import ship_package, write_scratch

HOT_KEYS = 1_000
HOT_ROWS = 1_000_000     # a key with more rows is hot, however large the table
REPLAY_ROWS = 200_000    # rows that one task may take in order
SWEEPS = 3               # rounds over all rows before they are told apart by component

Save = Callable[[DataFrame, str], DataFrame]


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """``key, order`` of the first row of each key."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def _flag_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Add the ``taken`` flag of each row's key from ``groups(key, n, taken)``, which has one
    row per key and counts its rows."""
    return look_up(rows, groups, key, "taken", total).withColumn("taken", F.coalesce("taken", F.lit(False)))


def look_up(rows: DataFrame, groups: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """Add the ``value`` of each row's key from ``groups(key, n, value)``; NULL where there is none.

    A key with over 1/HOT_KEYS of all rows, or over HOT_ROWS, is hot. There are few of those (fewer
    than HOT_KEYS, or one for each HOT_ROWS rows), so they are looked up by broadcast and their
    rows never meet in one task. The other rows are joined by shuffle.
    """
    hot_size = min(max(total // HOT_KEYS, 1), HOT_ROWS)
    hot = groups.filter(F.col("n") > hot_size).select(key, F.struct(F.col(value)).alias("hot_value"))
    cold = groups.filter((F.col("n") <= hot_size) & F.col(value).isNotNull()).select(key, value)
    tagged = rows.join(F.broadcast(hot), key, "left")
    settled = tagged.filter(F.col("hot_value").isNotNull()).withColumn(value, F.col("hot_value")[value]).drop("hot_value")
    others = tagged.filter(F.col("hot_value").isNull()).drop("hot_value").join(cold, key, "left")
    return settled.unionByName(others)


def exists_in(df: DataFrame, stored: DataFrame, key: str, flag: str = "known", save: Save = write_scratch) -> DataFrame:
    """Annotate each row with whether its key is in ``stored``.

    The keys are counted first, so each meets the store once however many rows share it, and
    the store is reduced to those keys before anything else: while their file is small, Spark
    sends them to the scan of the store, which is then neither shuffled nor sorted.
    """
    counted = save(df.groupBy(key).agg(F.count("*").alias("n")), "keys")
    hits = stored.select(key).join(counted.select(key), key, "left_semi").distinct().withColumn("taken", F.lit(True))
    groups = save(counted.join(hits, key, "left").withColumn("taken", F.coalesce("taken", F.lit(False))), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return _flag_groups(df, groups, key, total).withColumnRenamed("taken", flag)


def drop_known(keys: DataFrame, stored: DataFrame, key: str, save: Save = write_scratch) -> DataFrame:
    """Rows of ``keys`` whose ``key`` is not in ``stored``."""
    return exists_in(keys, stored, key, "known", save).filter(~F.col("known")).drop("known")


def first_wins_pairs(
    keys: DataFrame, order: str | tuple[str, ...] = "page_id", url: str = "url", content: str = "hash",
    save: Save = write_scratch,
) -> DataFrame:
    """The rows that a one-by-one ingest in ``order`` would store, as ``order, url, hash``.

    A row is stored when neither its url nor its content was stored before it; a row skipped
    for its content does not reserve its url. ``order``, one column or several, must be unique.
    Rows without a url or content are never stored and block nothing.

    Up to REPLAY_ROWS rows are taken one by one in a single task. Of more, a round stores all rows
    that come first both in their url group and in their content group, and removes what they
    block. What is left after SWEEPS rounds falls into components, rows that share urls or contents
    directly or through others: components of up to REPLAY_ROWS rows are taken one by one, many in
    a task, and only larger ones go on by rounds.
    """
    place = F.col(order) if isinstance(order, str) else F.struct(*order)
    keys = keys.filter(F.col(url).isNotNull() & F.col(content).isNotNull())
    rest = keys.groupBy(F.col(url).alias("u"), F.col(content).alias("h")).agg(F.min(place).alias("o"))
    rest = save(rest.select("o", "u", "h"), "rest")
    left = rest.count()
    kept, sweeps = [], 0
    while left:
        if left <= REPLAY_ROWS:
            kept.append(save(_replayed(rest.withColumn("component", F.lit(0)), 1), "replayed"))
            break
        if sweeps == SWEEPS:
            small, rest = _by_component(rest, left, save)
            kept.append(save(_replayed(small), "replayed"))
            left = rest.count()
            sweeps += 1
            continue
        firsts, n_taken, n_urls, n_contents = _firsts(rest, save)
        kept.append(firsts.filter(F.col("u").isNotNull() & F.col("h").isNotNull()).select("o", "u", "h"))
        if n_taken in (n_urls, n_contents):  # every url or every content is taken: all other rows are blocked
            break
        rest = save(_not_blocked(rest, firsts, left), "rest")
        before, left, sweeps = left, rest.count(), sweeps + 1
        if left >= before:
            raise RuntimeError("a round of deduplication removed no row; is the order unique?")
    result = functools.reduce(DataFrame.unionByName, kept) if kept else rest
    places = [F.col("o").alias(order)] if isinstance(order, str) else [F.col("o")[c].alias(c) for c in order]
    return result.select(*places, F.col("u").alias(url), F.col("h").alias(content))


def _firsts(rest: DataFrame, save: Save) -> tuple[DataFrame, int, int, int]:
    """``o, u, h`` of the rows that are first of their url or their content, both where they are first of both."""
    by_url = rest.groupBy("u").agg(F.min("o").alias("o"), F.count("*").alias("n_u"))
    by_content = rest.groupBy("h").agg(F.min("o").alias("o"), F.count("*").alias("n_h"))
    firsts = save(by_url.join(by_content, "o", "full_outer"), "firsts")
    counts = firsts.agg(F.count_if(F.col("u").isNotNull() & F.col("h").isNotNull()), F.count("u"), F.count("h")).first()
    return firsts, *counts


def _not_blocked(rest: DataFrame, firsts: DataFrame, total: int) -> DataFrame:
    taken = F.col("u").isNotNull() & F.col("h").isNotNull()
    for key in ("u", "h"):
        groups = firsts.filter(F.col(key).isNotNull()).select(key, F.col(f"n_{key}").alias("n"), taken.alias("taken"))
        rest = _flag_groups(rest, groups, key, total).filter(~F.col("taken")).drop("taken")
    return rest.select("o", "u", "h")


def _replayed(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows stored when each component is taken one by one; a task holds the keys of one component at a time."""
    ship_package(rows.sparkSession)
    schema = rows.select("o", "u", "h").schema

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, urls, contents = None, set(), set()
        for batch in batches:
            stored = []
            columns = [batch.column(c).to_pylist() for c in ("component", "u", "h")]
            for i, (component, u, h) in enumerate(zip(*columns)):
                if component != now:
                    now, urls, contents = component, set(), set()
                if u not in urls and h not in contents:
                    urls.add(u)
                    contents.add(h)
                    stored.append(i)
            yield batch.select(["o", "u", "h"]).take(pa.array(stored, pa.int64()))

    dealt = rows.repartition(tasks) if tasks else rows.repartition("component")
    return dealt.sortWithinPartitions("component", "o").select("component", "o", "u", "h").mapInArrow(replay, schema)


def _by_component(rest: DataFrame, total: int, save: Save) -> tuple[DataFrame, DataFrame]:
    """The rows of components of up to REPLAY_ROWS rows, with their component, and the rows of larger ones.

    A row takes the least label of its url's and its content's rows, then the label of the row that
    the label names, until nothing changes: the distance to the least row halves every round.
    """
    rows = save(rest.withColumn("id", F.monotonically_increasing_id()), "numbered")
    labels = save(rows.withColumn("label", F.col("id")), "labels")
    while True:
        step = labels.withColumnRenamed("label", "was").withColumn("label", F.col("was"))
        for key in ("u", "h"):
            least = labels.groupBy(key).agg(F.min("label").alias("least"), F.count("*").alias("n"))
            step = look_up(step, least, key, "least", total).withColumn("label", F.least("label", "least")).drop("least")
        step = save(step, "step")
        of = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        counts = step.groupBy("label").agg(F.count("*").alias("n")).join(of, "label")
        step = save(look_up(step, counts, "label", "next", total), "labels").withColumn("label", F.col("next")).drop("next")
        labels = step.drop("was")
        if step.filter("was <> label").isEmpty():
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    flags = sizes.withColumn("large", F.col("n") > REPLAY_ROWS)
    flagged = save(look_up(labels, flags, "label", "large", total).withColumnRenamed("label", "component"), "components")
    small = flagged.filter(~F.col("large")).select("component", "o", "u", "h")
    return small, flagged.filter("large").select("o", "u", "h")

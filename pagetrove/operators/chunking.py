"""Article text to paragraphs, paragraphs to chunks, chunks to numbered rows.

All steps work inside one row, so a table of pages is chunked without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrove.functions.bind import bind
from pagetrove.functions.text import sentence_count, trim_blank, utf16_length

_TEXTS = "array<string>"


def clean_paragraph(paragraph: Column, normalize: str = "first") -> Column:
    """Trim, then turn the first tab and the first double space into one space.

    Both lie inside the trimmed text, so nothing is left to trim afterwards.
    ``normalize="all"`` squeezes every run of blanks instead.
    """
    if normalize == "all":
        return F.regexp_replace(trim_blank(paragraph), r"[\t ]+", " ")

    def first_to_space(text: Column, mark: str) -> Column:
        replace = lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, f"(?s)^(.*?){mark}", "$1 ")).otherwise(t)
        return bind(text, replace)

    return first_to_space(first_to_space(trim_blank(paragraph), "\t"), "  ")


def paragraphs(text: Column, separator: str = "\n\n", normalize: str = "first") -> Column:
    """Cleaned, non-empty paragraphs in order."""
    cleaned = F.transform(F.split(text, separator), lambda p: clean_paragraph(p, normalize))
    return F.filter(cleaned, lambda p: p != "")


def merge_single_sentences(paras: Column) -> Column:
    """Join a one-sentence paragraph with the paragraph after it, left to right.

    A paragraph that was joined to its predecessor is not looked at again. A one-sentence
    paragraph at the end stays alone.

    The paragraphs are written as a text of one mark each, "1" for one sentence and "0" for
    more; replacing "1" and what follows it, left to right, by "1m" marks those that were
    joined. That takes time linear in the number of paragraphs.
    """
    single = F.transform(paras, lambda p: F.when(sentence_count(p) == 1, "1").otherwise("0"))
    marks = F.split(F.regexp_replace(F.array_join(single, ""), "1[01]", "1m"), "")

    def joined(m: Column) -> Column:
        both = F.transform(paras, lambda p, i: F.when(
            F.coalesce(F.get(m, i + 1) == "m", F.lit(False)), F.concat(p, F.lit("\n"), F.get(paras, i + 1))).otherwise(p))
        return F.filter(both, lambda p, i: F.get(m, i) != "m")

    return bind(marks, joined)


def pack_chunks(paras: Column, chunk_size: int = 1000, min_tail: int = 5, drop_empty: bool = False) -> Column:
    """Fill chunks with whole paragraphs, each followed by a line break.

    A chunk is closed when the next paragraph would take it past ``chunk_size``; a paragraph
    is never split, so a long first one closes an empty chunk before it. A last chunk of
    ``min_tail`` characters or fewer is dropped.
    """
    start = F.struct(
        F.array().cast(_TEXTS).alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"),
    )

    def step(acc: Column, para: Column) -> Column:
        p, size = para["text"], para["size"]
        full = acc["size"] + size > chunk_size
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["open"]), p, F.lit("\n")).alias("open"),
            (F.when(full, F.lit(0)).otherwise(acc["size"]) + size + 1).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["size"] > min_tail, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    measured = F.transform(paras, lambda p: F.struct(p.alias("text"), utf16_length(p).alias("size")))
    chunks = F.aggregate(measured, start, step, finish)
    return F.filter(chunks, lambda c: c != "") if drop_empty else chunks


def chunk_text(text: Column, config) -> Column:
    return pack_chunks(
        merge_single_sentences(paragraphs(text, normalize=config.normalize)),
        config.chunk_size, config.min_tail, config.drop_empty,
    )


def content_hash(chunks: Column) -> Column:
    return F.sha2(F.array_join(chunks, "\n"), 256)


def number_chunks(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk of ``df(url, title, chunks)``: ``id, pid, url, chunk``.

    Parts count from 1; the stored text starts with a line naming title, part and address.
    """
    rows = df.select(*keep, "url", "title", F.size("chunks").alias("parts"), F.posexplode("chunks").alias("pos", "body"))
    part = (F.col("pos") + 1).cast("string")
    pid = F.concat_ws("-", "url", part)
    text = F.concat(
        F.col("title"), F.lit(" part "), part, F.lit(" of "), F.col("parts").cast("string"),
        F.lit(" ("), F.col("url"), F.lit("):\n"), F.col("body"),
    )
    return rows.select(*keep, F.sha2(pid, 256).alias("id"), pid.alias("pid"), "url", text.alias("chunk"))

"""Language-model scores from a weighted backoff automaton over word n-grams.

The model is a discounted 3-gram model over the training tokens. Its words make up the root: a
word's arc weighs log10((c - D) / N), and what the discount D frees, D * V / N, is the weight of
all unknown words together. N-grams of two and three words seen ``least_count`` times, however many
there are, are arcs from the state of their history; where a state has no arc for a token, its
failure arc leads to the shorter history and weighs log10 of the backoff factor, which makes each
state's weights sum to one. One traversal from left to right carries the state and adds weights.

What is held where: n-grams, their arcs and backoff factors are counted and weighed in tables. By
counting alone, at most 1/share n-grams of one length reach a share of the tokens: these common ones
(and common words, which have root arcs of their own) make up the automaton that is sent to all tasks,
with the factors of the whole model. For all others the traversal asks the table: one join adds what
it says the n-gram's arc weighs more than the path by the failure arc (``gain``). An n-gram is rare
there by definition, so no key of that join is hot. Bitmaps of fixed size tell tasks of most n-grams
without an arc; a false hit meets no row of the table and adds nothing.

What is shuffled: an n-gram of common words is one number, made of its words' numbers; others are
texts. A task sorts the n-grams of a block of texts and deals them out by a hash into parts, each a
row: the sorted numbers' differences as planes of bytes, and how often each is seen or where. Parts are
counted, and meet their slice of the table, in arrays; a task holds a slice and reads request by request.

Defined results: null and empty texts are one end token. The words of texts are lowered in A-Z
only. A null id is in the fold of the empty id. Repeated rows count and are scored one by one.
Without training tokens all weights are those of the unknown word, log10(1) = 0. Only doc_id and
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.session import Scratch, ship_package, write_scratch

from .common import fold, give_back, map_batches, slices, small_batches

END = b""  # no word is empty


@dataclass(frozen=True)
class LmConfig:
    root_share: float = 1e-6   # words at least this frequent have root arcs in the automaton
    arc_share: float = 1e-5    # n-grams of two or three words at least this frequent have their arcs in it, too
    least_count: int = 3       # n-grams of two or three words seen so often have arcs, in it or in the table
    discount: float = 0.75     # of n-grams of two and three words


@dataclass
class Automaton:
    """States are numbers, 0 is the root. ``arcs`` maps state * words + word to (weight, next state)."""

    words: dict[bytes, int]
    counts: np.ndarray
    arcs: dict[int, tuple[float, int]]
    fail: list[int]
    backoff: list[float]
    start: int
    common: set[bytes] = field(default_factory=set)  # n-grams of two and three words that have arcs


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


MAX_BITS = 28  # of a bitmap's places
BATCH_BYTES = 2 << 20  # of texts whose words a worker holds at a time
BLOCK_BYTES = 12 << 20  # of texts whose n-grams a worker sorts at a time
RUN = 1 << 18  # tokens that arrays of all places are made for at a time
PART = 1 << 23  # n-grams that a part counts, about, if no block repeats one
CODED = 1 << 20  # words whose n-grams are numbers; three of their numbers fit into 60 bits


def hashes(words: list[bytes]) -> np.ndarray:
    """For bitmaps alone, where equal hashes of two words do no harm."""
    return np.fromiter(map(crc32, words), np.uint64, len(words)) * np.uint64(0xD6E8FEB86659FD93)


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of n-grams from those of their histories and last words."""
    mixed = (history ^ (history >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    return mixed ^ (mixed << np.uint64(31))


@dataclass
class Bitmap:
    """Where n-grams of a table are, by the first bits of their hash."""

    grams: int
    bits: int
    marks: np.ndarray

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(grams: DataFrame, column: str) -> Bitmap:
    """About 16 places an n-gram, up to 32 MB of them; then false hits become more frequent."""
    n = grams.count()
    bits = min(MAX_BITS, max(10, (16 * n).bit_length()))

    def each(batch: pa.RecordBatch) -> dict:
        words = pc.split_pattern(batch.column(0).cast(pa.string()), " ")
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        all_, first = hashes(words.flatten().cast(pa.binary()).to_pylist()), np.cumsum(lengths) - lengths
        h = all_[first]
        for k in range(1, int(lengths.max(initial=1))):
            more = lengths > k
            h[more] = longer(h[more], all_[first[more] + k])
        at = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
        return {"slot": at >> 6, "mark": np.left_shift(np.int64(1), at & 63)}

    set_ = map_batches(grams.select(column), "slot long, mark long", each, BATCH_BYTES).groupBy("slot").agg(F.bit_or("mark").alias("mark")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[set_["slot"].to_numpy()] = set_["mark"].to_numpy().view(np.uint64)
    return Bitmap(n, bits, marks)


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, as many as the largest number needs; high planes compress to little."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<i8").ravel().astype(np.int64, copy=False)


def lines(grams: list[bytes]) -> bytes:
    """No word holds a line break."""
    return b"\n".join(grams) + b"\n" if grams else b""


def unlines(data: bytes) -> list[bytes]:
    return data.split(b"\n")[:-1]


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted numbers are among the keys, which are in order, and where."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)), at


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def part_of_texts(grams: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(crc32, grams), np.int64, len(grams)) % parts


@dataclass
class Coder:
    """Words with root arcs, the most frequent first. The first ``base`` of them make up n-grams that are numbers."""

    words: list[bytes]
    counts: np.ndarray
    number: dict[bytes, int]
    hash: np.ndarray
    base: int

    def code(self, gram: bytes) -> int:
        """The number of an n-gram of two or three words, or -1. Triples come after all pairs."""
        code, words = 0, gram.split(b" ")
        for w in words:
            at = self.number.get(w, CODED)
            if at >= self.base:
                return -1
            code = code * self.base + at
        return -1 if len(words) < 2 else code + self.base ** 2 * (len(words) - 2)

    def codes(self, grams: pa.Array) -> np.ndarray:
        """The same of many."""
        words = pc.split_pattern(grams, " ")
        lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
        at = pc.index_in(words.flatten().cast(pa.binary()), value_set=pa.array(self.words[:self.base], pa.binary()))
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        first = np.cumsum(lengths) - lengths
        code, ok = np.zeros(len(lengths), np.int64), lengths > 1
        for k in range(int(lengths.max(initial=1))):
            more = lengths > k
            word = at[first[more] + k]
            code[more] = code[more] * self.base + word
            ok[more] &= word >= 0
        return np.where(ok, code + self.base ** 2 * (lengths - 2), -1)

    def gram(self, code: np.ndarray, n: int) -> list[bytes]:
        w, words = self.words, []
        for _ in range(n):
            code, at = np.divmod(code, self.base)
            words.append(at.tolist())
        return list(map(b" ".join, zip(*[map(w.__getitem__, x) for x in reversed(words)])))


def common_words(counts: DataFrame, n: int, config: LmConfig) -> DataFrame:
    return counts.filter(F.col("c") >= max(config.least_count, config.root_share * n))


def by_frequency(words: list[tuple]) -> list[tuple]:
    return sorted(words, key=lambda r: (-r[1], r[0]))


def coder(counts: DataFrame, n: int, config: LmConfig) -> Coder:
    rows = common_words(counts, n, config).select(F.col("word").cast("string").alias("word"), "c").collect()
    rows = by_frequency([(r.word.encode(), r.c) for r in rows])
    words = [w for w, _ in rows]
    return Coder(words, np.array([c for _, c in rows], np.int64), {w: i for i, w in enumerate(words)}, hashes(words), min(len(words), CODED))


BLOCKS = "words binary, tokens binary, texts binary"


def tokenized(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of the texts, the end token first, and the tokens as numbers of these from 1 on, between end
    tokens and with a 0 after each text. Words as in ``split``."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    ends = np.cumsum(pc.list_value_length(found).to_numpy().astype(np.int64))
    flat = found.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    n = np.diff(np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[np.concatenate([[0], ends])])
    coded = flat.filter(full).dictionary_encode()
    last = np.cumsum(n + 3) - 1
    tokens = np.ones(int((n + 3).sum()), np.int32)
    word = np.ones(len(tokens), bool)
    word[last - n - 2] = word[last - 1] = word[last] = False
    tokens[word] = coded.indices.to_numpy() + 2
    tokens[last] = 0
    return [END, *coded.dictionary.cast(pa.binary()).to_pylist()], tokens


def blocks(docs: DataFrame) -> DataFrame:
    """Texts (row, doc_id, train, text) as rows for blocks of them: words, tokens, and the other columns."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = arrow_kind(BLOCKS)

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        words, tokens = tokenized(table.column("text").combine_chunks())
        row = {"words": lines(words), "tokens": pack(tokens), "texts": to_bytes(table.drop_columns(["text"]))}
        return pa.RecordBatch.from_pylist([row], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)
        del held
        give_back()

    return docs.mapInArrow(run, BLOCKS)


def coded(train: DataFrame) -> DataFrame:
    """Texts that are not in blocks yet, all of them for training."""
    if "tokens" in train.columns:
        return train
    return blocks(train.select(F.lit(0).cast("long").alias("row"), "doc_id", F.lit(True).alias("train"), "text"))


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over whole texts, the end token among them once a text; counted within blocks before the shuffle."""

    def each(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"word": [], "c": []}
        for r in batch.to_pylist():
            tokens, words = unpack(r["tokens"]), unlines(r["words"])
            lengths = np.diff(np.flatnonzero(tokens == 0), prepend=-1)
            held = np.repeat(from_bytes(r["texts"]).column("train").to_numpy(), lengths)
            c = np.bincount(tokens[held], minlength=len(words) + 1)
            c[1] //= 2  # the end token, in front of texts, too
            out["word"].append(pa.array(words, pa.binary()).filter(pa.array(c[1:] > 0)))
            out["c"].append(pa.array(c[1:][c[1:] > 0]))
        return {k: pa.concat_arrays(x) for k, x in out.items()}

    return map_batches(coded(train), "word binary, c long", each).groupBy("word").agg(F.sum("c").alias("c"))


class Texts:
    """The tokens of a block between end tokens: ``a`` are numbers of words, those of the coder first and
    then the block's own ``words``; -1 parts the texts."""

    def __init__(self, coder: Coder, block: dict):
        self.coder, self.size = coder, len(coder.words)
        words = unlines(block["words"])
        number = np.fromiter(map(coder.number.get, words, repeat(-1)), np.int64, len(words))
        own = np.flatnonzero(number < 0)
        self.words = [words[i] for i in own.tolist()]
        number[own] = self.size + np.arange(len(own))
        self.a = np.concatenate([[-1], number])[unpack(block["tokens"])]
        self.first = np.concatenate([[0], np.flatnonzero(self.a < 0) + 1])
        self.lengths = np.diff(self.first)
        self.hash = np.concatenate([coder.hash, hashes(self.words)])
        self.texts = from_bytes(block["texts"])

    def trained(self) -> "Texts":
        """Without the texts that are held out."""
        self.a[~np.repeat(self.texts.column("train").to_numpy(), self.lengths)] = -1
        return self

    def runs(self) -> Iterator[slice]:
        """The places of about RUN tokens, whole texts, which arrays are made for at a time."""
        ends = self.first[np.searchsorted(self.first, np.arange(RUN, len(self.a) + RUN, RUN).clip(max=len(self.a)))]
        ends = np.unique(ends).tolist()
        yield from map(slice, [0, *ends], ends)

    def held(self, pairs: Bitmap, triples: Bitmap | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Whether a pair that may be held starts at a place, and a triple of such pairs that may be held itself."""
        two, three = np.zeros(len(self.a), bool), np.zeros(len(self.a), bool)
        for run in self.runs():
            a = self.a[run]
            h = self.hash[a]
            value = longer(h[:-1], h[1:])
            ok = (a[:-1] >= 0) & (a[1:] >= 0) & pairs.may_hold(value)
            two[run][:-1] = ok
            three[run][:-2] = ok[:-1] & ok[1:]
            if triples:
                three[run][:-2] &= triples.may_hold(longer(value[:-1], h[2:]))
        return two, three

    def gram(self, at: np.ndarray, n: int) -> list[bytes]:
        word = (self.coder.words + self.words).__getitem__
        return list(map(b" ".join, zip(*[map(word, self.a[at + k].tolist()) for k in range(n)])))

    def codes(self, ok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams that start where ``ok`` says: places and numbers of those of coded words; places of the
        others, and numbers that tell these apart within the block."""
        base, size = self.coder.base, self.size + len(self.words)
        found = []
        for run in self.runs():
            a, at = self.a[run], np.flatnonzero(ok[run])
            words = [a[at + k] for k in range(n)]
            coded = np.logical_and.reduce([w < base for w in words])
            code = np.zeros(int(coded.sum()), np.int64)
            for w in words:
                code = code * base + w[coded]
            rest = at[~coded]
            found.append((at[coded] + run.start, code, rest + run.start, a[rest] * size + a[rest + 1]))
        at, code, rest, other = (np.concatenate(x) for x in zip(*found))
        if n == 3:
            _, other = np.unique(other, return_inverse=True)
            other = other * size + self.a[rest + 2]
        return at, code, rest, other


def map_blocks(df: DataFrame, schema: str, coder: Callable[[], Coder], each: Callable[[Texts], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` from blocks to rows."""
    kind = arrow_kind(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in each(Texts(coder(), batch.slice(i, 1).to_pylist()[0])):
                    yield pa.RecordBatch.from_pylist([row], schema=kind)
        give_back()

    return df.mapInArrow(run, schema)


def count_ngrams(train: DataFrame, coder: Coder, words: Bitmap, pairs: Bitmap | None, least: int, parts: int) -> DataFrame:
    """(gram, c, first, last) of the pairs, or with ``pairs`` of the triples, seen at least so often; words are
    blank-joined. Counts of the first and last word are given where all words are coded.

    An n-gram can't be more frequent than its parts, so those of rarer parts needn't be counted.
    """
    sent = train.sparkSession.sparkContext.broadcast((coder, words, pairs))
    n = 2 if pairs is None else 3

    def each(t: Texts) -> Iterator[dict]:
        _, words, pairs = sent.value
        t.trained()
        if pairs is None:
            held = words.may_hold(t.hash)
            ok = (t.a >= 0) & held[t.a]
            ok[:-1] &= ok[1:]
        else:
            _, ok = t.held(pairs)
        _, code, rest, other = t.codes(ok, n)
        codes, seen = np.unique(code, return_counts=True)
        _, first, times = np.unique(other, return_index=True, return_counts=True)
        grams = t.gram(rest[first], n)
        for part, own, texts in shares(part_of(codes, parts), part_of_texts(grams, parts), parts):
            yield {"part": part, "codes": pack(np.diff(codes[own], prepend=0)), "seen": pack(seen[own]),
                   "grams": lines([grams[i] for i in texts.tolist()]), "times": pack(times[texts])}

    def add(group: pa.Table) -> pa.Table:
        coder = sent.value[0]
        read = {k: group.column(k).to_pylist() for k in ("codes", "seen", "grams", "times")}
        codes = np.concatenate([np.cumsum(unpack(x)) for x in read["codes"]])
        order = np.argsort(codes)
        codes, seen = codes[order], np.concatenate([unpack(x) for x in read["seen"]])[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        c = np.add.reduceat(seen, first) if len(first) else seen
        held = c >= least
        codes, base = codes[first][held], max(coder.base, 1)
        names = coder.gram(codes, n)
        texts = pc.split_pattern(pa.array([b"".join(read["grams"])[:-1]], pa.large_binary()).cast(pa.large_string()), "\n").flatten()
        if any(read["grams"]):
            other = pa.table({"gram": texts, "c": np.concatenate([unpack(x) for x in read["times"]])}).group_by("gram").aggregate([("c", "sum")])
            other = other.filter(pc.greater_equal(other.column("c_sum"), least))
        else:
            other = pa.table({"gram": texts[:0], "c_sum": pa.array([], pa.int64())})
        ends = [np.concatenate([coder.counts[at], np.zeros(len(other), np.int64)]) for at in (codes // base ** (n - 1), codes % base)]
        missing = np.arange(len(names) + len(other)) >= len(names)
        grams = [pa.array(names, pa.binary()).cast(pa.string()), *other.column("gram").cast(pa.string()).chunks]
        return pa.table({"gram": pa.chunked_array(grams), "c": np.concatenate([c[held], other.column("c_sum").to_numpy()]),
                         **{k: pa.array(x, pa.int64(), mask=missing) for k, x in zip(("first", "last"), ends)}})

    rows = map_blocks(train, "part int, codes binary, seen binary, grams binary, times binary", lambda: sent.value[0], each)
    return rows.groupBy("part").applyInArrow(add, "gram string, c long, first long, last long")


def shares(part: np.ndarray, text_part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places of its numbers in order, places of its texts)."""
    cuts = []
    for p in (part, text_part):
        order = np.argsort(p.astype(np.uint16) if parts < 1 << 16 else p, kind="stable")
        cuts.append((order, np.searchsorted(p[order], np.arange(parts + 1))))
    (order, cut), (text_order, text_cut) = cuts
    for p in range(parts):
        own, texts = order[cut[p]:cut[p + 1]], text_order[text_cut[p]:text_cut[p + 1]]
        if len(own) or len(texts):
            yield p, own, texts


@dataclass
class Tables:
    """words: (word, c, arc, back); pairs, triples: (gram, c, arc, back, gain). ``arc`` is the weight of
    the last word after the others, ``back`` the backoff factor of the n-gram as a history (null
    without arcs), both as log10."""

    words: DataFrame
    pairs: DataFrame
    triples: DataFrame
    maps: tuple[Bitmap, Bitmap]
    coder: Coder


def weigh(train: DataFrame, counts: DataFrame, n: int, rest: float, config: LmConfig) -> Tables:
    """Arcs and backoff factors of all n-grams; nothing of it is gathered."""
    with Scratch(train.sparkSession) as scratch:
        return weigh_in(scratch, coded(train), counts, n, rest, config)


def weigh_in(scratch: Scratch, train: DataFrame, counts: DataFrame, n: int, rest: float, config: LmConfig) -> Tables:
    least, d = config.least_count, config.discount
    c, total = F.col("c"), float(max(n, 1))
    code = coder(counts, n, config)
    parts = max(4 * train.sparkSession.sparkContext.defaultParallelism, n // PART)
    words = counts.select(F.col("word").cast("string").alias("word"), "c", F.log10((c - rest) / total).alias("arc"))
    known = bitmap(words.filter(c >= least), "word")
    pairs = scratch.write(count_ngrams(train, code, known, None, least, parts), "pairs")
    seen = bitmap(pairs, "gram")
    triples = scratch.write(count_ngrams(train, code, known, seen, least, parts), "triples")
    first, last = (F.substring_index("gram", " ", k) for k in (1, -1))

    def failed(arcs: DataFrame) -> DataFrame:
        """With the history's backoff factor: what its arcs leave over that part of the shorter history's mass they don't go on with."""
        of = Window.partitionBy("history")
        left, lower = (F.greatest(1 - F.sum(F.pow(F.lit(10.0), k)).over(of), F.lit(1e-9)) for k in ("arc", "lower"))
        return arcs.withColumn("failed", F.log10(left / lower))

    def backs(arcs: DataFrame, name: str) -> DataFrame:
        return arcs.groupBy(F.col("history").alias(name)).agg(F.max("failed").alias("back"))

    # What an arc weighs more than the failure arc and the shorter history's, and with it what its own state adds.
    gain = F.col("arc") - F.col("lower") - F.col("failed") + F.coalesce("back", F.lit(0.0))
    common = words.filter(c >= least)
    coded_ = pairs.filter(F.col("last").isNotNull()).select(
        "gram", "c", first.alias("history"), F.log10((F.col("last") - rest) / total).alias("lower"), F.col("first").alias("of"))
    two = pairs.filter(F.col("last").isNull()).select("gram", "c", first.alias("history"), last.alias("word"))
    two = two.join(common.select("word", F.col("arc").alias("lower")), "word")
    two = two.join(common.select(F.col("word").alias("history"), F.col("c").alias("of")), "history")
    two = two.select(coded_.columns).unionByName(coded_)
    two = two.select("gram", "c", "history", "lower", F.log10((c - d) / F.col("of")).alias("arc"))
    arcs = two = scratch.write(failed(two), "pair-arcs")
    three = triples.select("gram", "c", F.substring_index("gram", " ", 2).alias("history"), F.substring_index("gram", " ", -2).alias("suffix"))
    three = three.join(two.select(F.col("gram").alias("suffix"), F.col("arc").alias("lower")), "suffix")
    three = three.join(pairs.select(F.col("gram").alias("history"), F.col("c").alias("of")), "history")
    three = three.select("gram", "c", "history", "lower", F.log10((c - d) / F.col("of")).alias("arc"))
    three = scratch.write(failed(three), "triple-arcs")
    two = two.join(backs(three, "gram"), "gram", "left")
    return Tables(
        write_scratch(common.join(backs(arcs, "word"), "word", "left"), "lm-words").unionByName(
            words.filter(c < least).withColumn("back", F.lit(None).cast("double"))),
        write_scratch(two.select("gram", "c", "arc", "back", gain.alias("gain")), "lm-pair-weights"),
        write_scratch(three.withColumn("back", F.lit(None).cast("double")).select("gram", "c", "arc", "back", gain.alias("gain")), "lm-triple-weights"),
        (seen, bitmap(triples, "gram")), code)


def build(train: DataFrame, counts: DataFrame, n: int, v: int, rest: float, config: LmConfig, tables: Tables | None = None) -> Automaton:
    """The automaton of the common words, pairs and triples, with the weights of the whole model."""
    tables = tables or weigh(train, counts, n, rest, config)
    roots = by_frequency([(r.word.encode(), r.c, r.arc, r.back) for r in common_words(tables.words, n, config).collect()])
    words = {w: i for i, (w, *_) in enumerate(roots)}
    size = len(words)
    fail, backoff, state_of = [0], [0.0], {}

    def state(gram: bytes, back: float, shorter: int) -> None:
        state_of[gram] = len(fail)
        fail.append(shorter)
        backoff.append(back)

    for w, _, _, back in roots:
        if back is not None:
            state(w, back, 0)
    arcs = {i: (arc, state_of.get(w, 0)) for i, (w, _, arc, _) in enumerate(roots)}
    often = F.col("c") >= max(config.least_count, config.arc_share * n)
    pairs, triples = (sorted((r.gram.encode(), r.arc, r.back) for r in t.filter(often).select("gram", "arc", "back").collect())
                      for t in (tables.pairs, tables.triples))
    for gram, _, back in pairs:
        if back is not None:
            state(gram, back, state_of.get(gram.rpartition(b" ")[2], 0))
    for gram, arc, _ in pairs + triples:
        history, _, last = gram.rpartition(b" ")
        end = b" ".join(gram.split(b" ")[-2:])
        arcs[state_of[history] * size + words[last]] = (arc, state_of.get(end, state_of.get(last, 0)))
    return Automaton(words, np.array([c for _, c, *_ in roots], float), arcs, fail, backoff, state_of.get(END, 0),
                     {g for g, *_ in pairs + triples})


def weight_at(arcs, fail, backoff, size, state, w) -> float:
    total = 0.0
    while (arc := arcs.get(state * size + w)) is None:
        total += backoff[state]
        state = fail[state]
    return total + arc[0]


@dataclass
class Walk:
    """An automaton as arrays: the arcs of words from the root, and all others in the order of their keys."""

    root_weight: np.ndarray
    root_next: np.ndarray
    keys: np.ndarray
    weight: np.ndarray
    next: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray

    def arc(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether states, none of them the root, have arcs for words, and the places of these arcs."""
        return places(self.keys, state * len(self.root_weight) + word)


def walk(model: Automaton) -> Walk:
    size = len(model.words)
    root = [model.arcs[w] for w in range(size)]
    rest = sorted((k, *arc) for k, arc in model.arcs.items() if k >= size)
    return Walk(np.array([w for w, _ in root], float), np.array([s for _, s in root], np.int64),
                np.array([k for k, *_ in rest], np.int64), np.array([w for _, w, _ in rest], float),
                np.array([s for *_, s in rest], np.int64), np.array(model.fail, np.int64), np.array(model.backoff, float))


def traverse(m: Walk, words: np.ndarray) -> np.ndarray:
    """The weight of each place of texts between end tokens, but for root arcs of words that the automaton lacks.

    ``words`` are -1 where the automaton lacks a word, -2 between texts. The state after a word is that of
    the longest n-gram with a state that ends there, whatever the way: that of the arc for the word from
    the state of the word before alone, else that of the root's arc. So the states of all places are
    known at once, and all places follow their failure arcs together, to the root at most.
    """
    total = np.zeros(len(words))
    if not len(m.root_weight):
        return total
    known = words >= 0
    state = np.where(known, m.root_next[np.maximum(words, 0)], 0)
    at = np.flatnonzero(known[1:] & (state[:-1] > 0)) + 1
    found, arc = m.arc(state[at - 1], words[at])
    state[at[found]] = m.next[arc[found]]
    weighed = np.zeros(len(words), bool)
    weighed[1:] = (words[1:] > -2) & (words[:-1] > -2)
    now = np.concatenate([[0], state[:-1]])
    done = ~known
    at = np.flatnonzero(weighed & (now > 0))
    while len(at):
        found, arc = m.arc(now[at], words[at])
        found &= known[at]
        total[at[found]] += m.weight[arc[found]]
        done[at[found]] = True
        at = at[~found]
        total[at] += m.backoff[now[at]]
        now[at] = m.fail[now[at]]
        at = at[now[at] > 0]
    at = np.flatnonzero(weighed & ~done)
    total[at] += m.root_weight[words[at]]
    return total


@dataclass
class Request:
    """N-grams of a block, each once, and the texts of the block that hold them, an n-gram's after another's."""

    part: np.ndarray
    times: np.ndarray
    docs: np.ndarray

    def deal(self, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: places of its n-grams in order, times, texts."""
        order = np.argsort(self.part.astype(np.uint16) if parts < 1 << 16 else self.part, kind="stable")
        times = self.times[order]
        ends = np.cumsum(times)
        start = (np.cumsum(self.times) - self.times)[order]
        docs = self.docs[np.arange(len(self.docs)) + np.repeat(start - ends + times, times)]
        cut = np.searchsorted(self.part[order], np.arange(parts + 1))
        ends = np.concatenate([[0], ends])
        for p in range(parts):
            own = slice(cut[p], cut[p + 1])
            yield order[own], times[own], docs[ends[cut[p]]:ends[cut[p + 1]]]


def gathered(code: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes once, in order; a place of each; times; the texts in this order."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], order[first], np.diff(np.append(first, len(code))), docs[order]


REQUEST = "part int, side int, codes binary, grams binary, words int, times binary, docs binary, rows binary, own binary, gains binary"
SUMS = "row long, doc_id long, n_tokens long, n_known long, base double, score double"
SUMS_KIND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("base", pa.float64()), ("score", pa.float64())])
ROWS = 1 << 18  # of a table that a worker holds at a time


def ask(t: Texts, m: Walk, base: np.ndarray, common: tuple[np.ndarray, set[bytes]],
        maps: tuple[Bitmap, Bitmap], parts: int) -> Iterator[dict]:
    """Traverse a block; for each part what its slice of the table is asked, with one of them the sums so far."""
    size, n_docs, rows = t.size, len(t.lengths), t.texts
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), t.lengths)
    words = np.where(t.a < size, t.a, -1)
    words[t.a < 0] = -2
    weighed = t.a >= 0
    weighed[t.first[:-1]] = False
    at = np.flatnonzero(weighed & (words >= 0))
    sums = pa.table([rows.column("row"), rows.column("doc_id"), np.diff(t.first) - 2, np.bincount(doc[at], minlength=n_docs),
                     np.bincount(doc[at], base[words[at]], n_docs), np.bincount(doc, np.concatenate([traverse(m, words[run]) for run in t.runs()]), n_docs)], schema=SUMS_KIND)
    at = np.flatnonzero(weighed & (words < 0))
    number, _, times, docs = gathered(t.a[at], doc[at])
    grams = [t.words[i - size] for i in number.tolist()]
    n_words, texts, codes = len(grams), [(times, docs)], []
    two, three = t.held(*maps)
    for n, held in ((2, two), (3, three)):
        at, code, rest, other = t.codes(held, n)
        code, _, times, docs = gathered(code + t.coder.base ** 2 * (n - 2), doc[at])
        rare = ~places(common[0], code)[0]
        codes.append((code[rare], times[rare], docs[np.repeat(rare, times)]))
        _, place, times, docs = gathered(other, doc[rest])
        names = t.gram(rest[place], n)
        if t.coder.base < size:  # else a text has a word that is in no common n-gram
            rare = np.array([g not in common[1] for g in names], bool)
            times, docs = times[rare], docs[np.repeat(rare, times)]
            names = [g for g in names if g not in common[1]]
        texts.append((times, docs))
        grams += names
    del two, three, held, doc, words
    codes, times, docs = (np.concatenate(x) for x in zip(*codes))
    coded = Request(part_of(codes, parts), times, docs).deal(parts)
    others = Request(part_of_texts(grams, parts), *(np.concatenate(x) for x in zip(*texts))).deal(parts)
    row = rows.column("row").to_numpy()
    for part, (own, times, docs), (texts, text_times, text_docs) in zip(range(parts), coded, others):
        yield {
            "part": part, "side": 1, "codes": pack(np.diff(codes[own], prepend=0)), "grams": lines([grams[i] for i in texts.tolist()]),
            "words": int((texts < n_words).sum()), "times": pack(np.concatenate([times, text_times])),
            "docs": pack(np.concatenate([docs, text_docs])), "rows": pack(np.diff(row, prepend=0)),
            "own": to_bytes(sums) if part == row[0] % parts else None,
        }


def deal_table(table: DataFrame, coder, parts: int) -> DataFrame:
    """(gram, c, gain) as rows for the parts; ``coder`` is a broadcast one. A gram's count follows its gain."""
    kind = arrow_kind(REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield from each(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from each(pa.Table.from_batches(held))
        give_back()

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = rows.column("gram").combine_chunks()
        grams = names.cast(pa.binary()).to_pylist()
        gains = np.stack([rows.column("gain").to_numpy(), rows.column("c").to_numpy().astype(float)], 1)
        code = coder.value[0].codes(names)
        at, text = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
        at = at[np.argsort(code[at])]
        text_part = part_of_texts([grams[i] for i in text.tolist()], parts)
        for part, own, texts in shares(part_of(code[at], parts), text_part, parts):
            own, texts = at[own], text[texts]
            yield pa.RecordBatch.from_pylist([{
                "part": part, "side": 0, "codes": pack(np.diff(code[own], prepend=0)), "grams": lines([grams[i] for i in texts.tolist()]),
                "gains": gains[own, 0].tobytes() + gains[texts].tobytes()}], schema=kind)

    return table.mapInArrow(run, REQUEST)


class Slice:
    """What a part of the table says: gains of numbers; gains and counts of texts."""

    def __init__(self, rows: list[dict]):
        codes, gains, texts, weights = [np.zeros(0, np.int64)], [np.zeros(0)], [], [np.zeros((0, 2))]
        for r in rows:
            code, values = np.cumsum(unpack(r["codes"])), np.frombuffer(r["gains"])
            codes.append(code)
            gains.append(values[:len(code)])
            texts += unlines(r["grams"])
            weights.append(values[len(code):].reshape(-1, 2))
        self.codes = np.concatenate(codes)
        order = np.argsort(self.codes)
        self.codes, self.gains = self.codes[order], np.concatenate(gains)[order]
        self.texts = {g: i for i, g in enumerate(texts)}
        self.weights = np.concatenate(weights)

    def answer(self, r: dict, unknown: float, below: float) -> pa.RecordBatch:
        """The sums that a request's n-grams add to its texts, and what it brings itself."""
        rows = np.cumsum(unpack(r["rows"]))
        codes, times, docs = np.cumsum(unpack(r["codes"])), unpack(r["times"]), unpack(r["docs"])
        found, at = places(self.codes, codes)
        gain = np.zeros(len(times))
        gain[:len(codes)][found] = self.gains[at[found]]
        grams = unlines(r["grams"])
        at = np.fromiter(map(self.texts.get, grams, repeat(-1)), np.int64, len(grams))
        weights = np.zeros((len(grams), 2))
        weights[:r["words"], 0] = unknown
        weights[at >= 0] = self.weights[at[at >= 0]]
        gain[len(codes):] = weights[:, 0]
        known, base = np.zeros(len(times)), np.zeros(len(times))
        word = slice(len(codes), len(codes) + r["words"])
        c = weights[:r["words"], 1]
        known[word] = c > 0
        base[word] = np.log10((c + 0.5) / below)
        n_known, base, score = (np.bincount(docs, np.repeat(x, times), len(rows)) for x in (known, base, gain))
        if r["own"] is not None:
            own = from_bytes(r["own"])
            doc_id, n_tokens = own.column("doc_id").combine_chunks(), own.column("n_tokens").to_numpy()
            n_known, base, score = (x + own.column(k).to_numpy() for k, x in (("n_known", n_known), ("base", base), ("score", score)))
        else:
            seen = np.flatnonzero(np.bincount(docs, minlength=len(rows)))
            rows, n_known, base, score = rows[seen], n_known[seen], base[seen], score[seen]
            doc_id, n_tokens = pa.nulls(len(rows), pa.int64()), np.zeros(len(rows), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows), doc_id, pa.array(n_tokens), pa.array(n_known.astype(np.int64)),
                                           pa.array(base), pa.array(score)], schema=SUMS_KIND)


def arrow_kind(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def score(docs: DataFrame, held_out_fold: int = 1, config: LmConfig = LmConfig()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    texts = narrow(docs).withColumn("row", F.monotonically_increasing_id())
    trained = fold(F.col("doc_id")) != held_out_fold
    train = write_scratch(blocks(texts.select("row", "doc_id", trained.alias("train"), "text")), "lm-tokens", compression="zstd", maxRecordsPerFile=4)
    counts = write_scratch(count_words(train), "lm-counts")
    n, v, n1, n2 = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)),
        F.count(F.when(F.col("c") == 2, 1))).first()
    rest = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
    tables = weigh(train, counts, n, rest, config)
    model = build(train, counts, n, v, rest, config, tables)
    below = n + 0.5 * (v + 1)
    unknown = math.log10(rest * v / n) if n else 0.0
    rare = tables.words.filter(F.col("c") < max(config.least_count, config.root_share * n)).select(
        F.col("word").alias("gram"), "c", (F.col("arc") + F.coalesce("back", F.lit(0.0))).alias("gain"))
    for t in (tables.pairs, tables.triples):
        rare = rare.unionByName(t.filter(F.col("c") < max(config.least_count, config.arc_share * n)).select("gram", "c", "gain"))
    parts = max(4 * spark.sparkContext.defaultParallelism, n >> 25, (v + sum(m.grams for m in tables.maps)) >> 21)
    codes = sorted(x for x in map(tables.coder.code, model.common) if x >= 0)
    sent = spark.sparkContext.broadcast((
        tables.coder, walk(model), np.log10((model.counts + 0.5) / below), (np.array(codes, np.int64), model.common), tables.maps))
    requests = map_blocks(train, REQUEST, lambda: sent.value[0], lambda t: ask(t, *sent.value[1:], parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table, held = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["part"] != part:
                    part, table, held = r["part"], [], None
                if r["side"] == 0:
                    table.append(r)
                    continue
                held = held or Slice(table)
                table = []
                yield held.answer(r, unknown, below)
        give_back()

    both = requests.unionByName(deal_table(rare, sent, parts)).repartition(parts, "part").sortWithinPartitions("part", "side")
    sums = both.mapInArrow(meet, SUMS).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return sums.select(
        "doc_id", (fold(F.col("doc_id")) == held_out_fold).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

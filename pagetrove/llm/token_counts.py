"""Token counts of merge (BPE) models by rank-synchronous merging of ragged arrays.

A block of texts is one flat array of characters. It is cut between two characters that no piece
holds side by side, as no merge can reach over such a place; what lies between two cuts is a
pre-token. All pre-tokens of a block are merged together: each round finds the lowest rank of every
pre-token by one ``minimum.reduceat``, joins all its pairs of that rank at once (from the left,
where they overlap), and drops the pre-tokens without a pair left. What survives is counted.

Joining all pairs of a rank at once equals joining them one by one, unless a join makes a pair of
no higher rank beside a pre-token's other pairs (runs of spaces do, as their pieces share a score).
Such pre-tokens are found as they occur and merged one pair at a time from a heap.

Pre-tokens of at most 64 characters are counted once per block, under a 64-bit hash, and their
counts are kept in a worker within a bound in bytes. Texts go through in blocks of a fixed number
of characters however long they are. Documents are independent: Spark deals them out, nothing is
shuffled or sent to the driver.

Defined results: null and empty texts have no bytes and no tokens. A character in no piece counts
one token for each of its UTF-8 bytes. Repeated rows get equal counts, null ids stay null, an empty
table gives no rows, other columns are ignored. Models with another normaliser than the identity,
without byte fallback, or that don't merge, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, worker_cache

TOKEN_LIMIT = 4096
BLOCK_CHARS = 1 << 20
SHORT = 64                 # pre-tokens of up to so many characters are counted once
CACHE_BYTES = 12 << 20
# Fixed values of the model format: the meta symbol, kinds of pieces, the kind of merge models.
META, NORMAL, USER_DEFINED, BYTE, BPE = "▁", 1, 4, 6, 2
_NONE = np.iinfo(np.int32).max


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes in UTF-8."""
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


@dataclass(frozen=True, eq=False)
class MergeTable:
    """Symbols are numbered: 0 is any character in no piece, then the characters of pieces, then longer pieces."""

    char_ids: np.ndarray    # symbol of each code point
    joined: np.ndarray      # whether two characters stand side by side in a piece
    pairs: np.ndarray       # sorted: left * symbols + right
    into: np.ndarray        # the symbol that each pair becomes
    rank: np.ndarray        # of each symbol; lower merges first
    tokens: np.ndarray      # of each symbol: one, or its UTF-8 bytes if it is no piece
    prefix: bool
    name: str

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair becomes, 0 where it does not merge."""
        key = left.astype(np.int64) * len(self.rank) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.into[at], 0)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def compile_merges(path: str) -> MergeTable:
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        data = file.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only the identity normaliser with escaped white space is supported")
    if proto.trainer_spec.model_type != BPE or sum(p.type == BYTE for p in proto.pieces) != 256:
        raise ValueError("only merge models with byte fallback are supported")
    if any(p.type == USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
    return merge_table(scores, spec.add_dummy_prefix, hashlib.sha256(data).hexdigest())


def merge_table(scores: dict[str, float], prefix: bool = True, name: str = "") -> MergeTable:
    """From the score of each piece; a higher score merges first, equal scores from the left."""
    chars = sorted({c for p in scores for c in p})
    symbols = {c: i + 1 for i, c in enumerate(chars)}
    for p in scores:
        symbols.setdefault(p, len(symbols) + 1)
    size = len(symbols) + 1
    char_ids = np.zeros(0x110000, np.int32)
    char_ids[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    char_ids[ord(" ")] = char_ids[ord(META)]
    joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    found = []
    for p in scores:
        for i in range(1, len(p)):
            joined[symbols[p[i - 1]], symbols[p[i]]] = True
            if p[:i] in symbols and p[i:] in symbols:
                found.append((symbols[p[:i]] * size + symbols[p[i:]], symbols[p]))
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 2)
    steps = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
    rank, tokens = np.full(size, _NONE, np.int32), np.ones(size, np.int64)
    for p, i in symbols.items():
        if p in scores:
            rank[i] = steps[scores[p]]
        else:
            tokens[i] = len(p.encode())
    rank[0] = _NONE
    return MergeTable(char_ids, joined, table[:, 0], table[:, 1].astype(np.int32), rank, tokens, prefix, name)


def merged_one_by_one(table: MergeTable, symbols: np.ndarray) -> int:
    """Tokens of one pre-token, one pair at a time: the lowest rank first, from the left."""
    sym = symbols.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    pairs = {}
    heap: list[tuple[int, int, int, int]] = []

    def push(lefts: list[int]) -> None:
        missing = {(sym[i], sym[after[i]]) for i in lefts} - pairs.keys()
        if missing:
            left, right = np.array(sorted(missing)).T
            pairs.update(zip(zip(left.tolist(), right.tolist()), table.look_up(left, right).tolist()))
        for i in lefts:
            to = pairs[sym[i], sym[after[i]]]
            if to:
                heapq.heappush(heap, (int(table.rank[to]), i, sym[i], sym[after[i]]))

    push(list(range(n - 1)))
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j < 0 or sym[j] != right:
            continue
        sym[i], sym[j], after[i] = pairs[left, right], -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push([k for k in (before[i], i) if k >= 0 and after[k] >= 0])
    return int(table.tokens[[s for s in sym if s >= 0]].sum())


def merged_together(table: MergeTable, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens of each pre-token; pre-token i begins at ``starts[i]`` and ends where the next begins."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    sym, first, seq_start = symbols.astype(np.int64), starts, starts
    name = np.arange(len(starts))                                    # of each pre-token still at work
    seq = np.repeat(name, np.diff(np.append(starts, len(sym))))      # of each symbol: place in ``name``

    def pairs_at(at: np.ndarray) -> np.ndarray:
        """What the symbols at these places and their successors become, 0 at the end of a pre-token."""
        after = np.minimum(at + 1, len(sym) - 1)
        return np.where((after > at) & (seq[after] == seq[at]), table.look_up(sym[at], sym[after]), 0)

    into = pairs_at(np.arange(len(sym)))
    while len(sym):
        rank = table.rank[into]
        least = np.minimum.reduceat(rank, seq_start)
        working = least < _NONE
        if not working.all():
            sums = np.add.reduceat(table.tokens[sym], seq_start)
            out[name[~working]] = sums[~working]
            stays = working[seq]
            sym, into, rank, seq = sym[stays], into[stays], rank[stays], (np.cumsum(working) - 1)[seq[stays]]
            name, least = name[working], least[working]
            if not len(sym):
                break
        hit = np.nonzero(rank == least[seq])[0]
        run = np.concatenate([[0], np.nonzero(np.diff(hit) != 1)[0] + 1])
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[place % 2 == 0]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym[hit] = into[hit]
        at = (np.cumsum(keep) - 1)[hit]
        sym, into, seq = sym[keep], into[keep], seq[keep]
        changed = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
        into[changed] = pairs_at(changed)
        many = np.bincount(seq[at], minlength=len(name)) > 1
        early = changed[many[seq[changed]] & (table.rank[into[changed]] <= least[seq[changed]])]
        if len(early):
            alone = np.zeros(len(name), bool)
            alone[seq[early]] = True
            for k in name[alone].tolist():
                end = first[k + 1] if k + 1 < len(first) else len(symbols)
                out[k] = merged_one_by_one(table, symbols[first[k]:end])
            stays = ~alone[seq]
            sym, into, seq = sym[stays], into[stays], (np.cumsum(~alone) - 1)[seq[stays]]
            name = name[~alone]
        seq_start = np.nonzero(np.diff(seq, prepend=-1))[0]
    return out


class Counter:
    """A merge table with the counts of short pre-tokens seen before, within a bound in bytes."""

    def __init__(self, table: MergeTable):
        self.t = table
        random = np.random.default_rng(20)
        self.of_char = random.integers(1 << 63, size=len(table.joined), dtype=np.uint64)
        self.of_place = random.integers(1 << 63, size=SHORT, dtype=np.uint64) | np.uint64(1)
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def short(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens of 2 to ``SHORT`` characters."""
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = chars[np.repeat(starts, sizes) + place]
        offsets = np.cumsum(sizes) - sizes
        # The place of the last character is mixed in, so a longer pre-token has another hash.
        code = np.add.reduceat(self.of_char[flat] * self.of_place[place], offsets) ^ self.of_place[sizes - 1]
        codes, sample, back = np.unique(code, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, codes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == codes if len(self.hashes) else np.zeros(len(codes), bool)
        found = np.zeros(len(codes), np.int64)
        found[known] = self.counts[at[known]]
        if not known.all():
            rows = sample[~known]
            picked = sizes[rows]
            ends = np.cumsum(picked)
            inside = np.arange(int(ends[-1])) - np.repeat(ends - picked, picked)
            found[~known] = merged_together(self.t, flat[np.repeat(offsets[rows], picked) + inside], ends - picked)
            if 16 * (len(self.hashes) + len(rows)) > CACHE_BYTES:
                self.hashes, self.counts = codes, found
            else:
                self.hashes = np.concatenate([self.hashes, codes[~known]])
                self.counts = np.concatenate([self.counts, found[~known]])
                order = np.argsort(self.hashes)
                self.hashes, self.counts = self.hashes[order], self.counts[order]
        return found[back]

    def block(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block; ``begins`` is where the texts begin, none of them empty."""
        chars = self.t.char_ids[codes]
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.t.joined[chars[:-1], chars[1:]]
        cut[begins] = True
        starts = np.nonzero(cut)[0]
        sizes = np.diff(np.append(starts, len(chars)))
        tokens = np.zeros(len(starts), np.int64)
        one, short, long_ = sizes == 1, (sizes > 1) & (sizes <= SHORT), sizes > SHORT
        alone = starts[one]
        tokens[one] = np.where(chars[alone] == 0, utf8_sizes(codes[alone]), self.t.tokens[chars[alone]])
        if short.any():
            tokens[short] = self.short(chars, starts[short], sizes[short])
        if long_.any():
            ends = np.cumsum(sizes[long_])
            inside = np.arange(int(ends[-1])) - np.repeat(ends - sizes[long_], sizes[long_])
            tokens[long_] = merged_together(self.t, chars[np.repeat(starts[long_], sizes[long_]) + inside], ends - sizes[long_])
        return np.add.reduceat(tokens, np.searchsorted(starts, begins))

    def pieces(self, text: str):
        """A text as arrays of code points of about a block each, parted where no merge reaches over."""
        at, size = 0, BLOCK_CHARS
        lead = np.array([ord(" ")] if self.t.prefix else [], np.uint32)
        while at < len(text):
            codes = np.frombuffer(text[at:at + size + 1].encode("utf-32-le"), np.uint32)
            end = len(codes)
            if at + size + 1 < len(text):
                chars = self.t.char_ids[codes]
                cuts = np.nonzero(~self.t.joined[chars[:-1], chars[1:]])[0]
                if not len(cuts):
                    size *= 2
                    continue
                end = int(cuts[-1]) + 1
            yield np.concatenate([lead, codes[:end]])
            lead = lead[:0]
            at, size = at + end, BLOCK_CHARS

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        waiting: list[np.ndarray] = []
        rows: list[int] = []

        def flush() -> None:
            if waiting:
                codes = np.concatenate(waiting)
                sizes = np.array([len(w) for w in waiting])
                begins = np.cumsum(sizes) - sizes
                np.add.at(n_tokens, rows, self.block(codes, begins))
                np.add.at(n_bytes, rows, np.add.reduceat(utf8_sizes(codes), begins))
                waiting.clear()
                rows.clear()

        held = 0
        for row, text in enumerate(texts):
            if text and self.t.prefix:
                n_bytes[row] -= 1
            for codes in self.pieces(text or ""):
                if held + len(codes) > BLOCK_CHARS:
                    flush()
                    held = 0
                waiting.append(codes)
                rows.append(row)
                held += len(codes)
        flush()
        return n_bytes, n_tokens


def count(docs: DataFrame, table: MergeTable, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # as large as the model, whatever the documents

    def each(batch: pa.RecordBatch) -> dict:
        counter = worker_cache(f"merges {shared.value.name}", lambda: Counter(shared.value))
        n_bytes, n_tokens = counter.count(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(narrow, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", each, 4 << 20)

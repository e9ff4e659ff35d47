"""SentencePiece encoding and decoding as a shortest path through a composed transducer.

``compile_model`` reads a model file into three machines: the normaliser (dummy prefix; the meta
symbol and the space are one, written as a space here), the pieces, and byte fallback for characters that no piece holds. ``encode``
composes them with one input: states are positions, an arc is a piece or a fallback character, and
weights are added along a path and the least sum wins (the tropical semiring).

* Unigram models: an arc weighs minus its piece's score.
* BPE models: an arc weighs 0 where its piece can follow the piece before it, and is infinite
  otherwise. A sequence is the merge result of its text if and only if each two neighbours are
  the merge result of their own text, so exactly one path through a text is finite.

No piece holds a space after another character, nor a character that occurs in no longer
piece; the input is cut there, each part is composed once per worker and kept in a bounded cache.
Texts are independent, so Spark deals them out and nothing is shuffled.

Defined results: null and empty texts have no tokens. Repeated rows get equal tokens. Decoding
gives the text back except that the meta symbol U+2581 in a text becomes a space (as in the
format itself); ``round_trip`` says so for each text. Characters without UTF-8 form don't occur
in Spark strings. Models with a compiled character map are refused.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, worker_cache

META = "▁"
# Fixed values of the model format: kinds of pieces, kinds of models.
NORMAL, USER_DEFINED, BYTE, UNIGRAM, BPE = 1, 4, 6, 1, 2
UNKNOWN_PENALTY = 10.0
CACHE_BYTES = 128 << 20  # of a worker's caches; an entry takes about 150 bytes beside its text
PAIR_BYTES = 32 << 20    # of these, for pairs; one takes about 110 bytes, and 300 the first of a piece
HEAD, SHORTER = 3, (2, 1)  # first characters that tell how long a piece may be, and the lengths below
DECODED = 1 << 16        # ids whose bytes are looked up at a time
BATCH_BYTES = 1 << 20    # of texts whose ids a worker holds at a time, beside its caches


@dataclass(frozen=True)
class Machine:
    pieces: dict[str, int]
    scores: dict[str, float]
    bytes_of: tuple[bytes, ...]   # what each id is in a decoded text
    byte_ids: tuple[int, ...]     # 256 ids, or none
    unknown: int
    prefix: bool
    bpe: bool
    longest: int
    parts: str                    # a pattern that cuts normalised text where no piece reaches over
    name: str


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def compile_model(path: str) -> Machine:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        data = file.read()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only the identity normaliser with escaped white space is supported")
    pieces, scores, table, byte_ids, unknown = {}, {}, [], {}, 0
    for i, p in enumerate(proto.pieces):
        text = b""
        if p.type in (NORMAL, USER_DEFINED):
            piece = p.piece.replace(META, " ")
            pieces[piece], scores[piece] = i, p.score
            text = piece.encode()
        elif p.type == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            text = bytes([int(p.piece[3:5], 16)])
        elif p.type == 2:
            unknown, text = i, " ⁇ ".encode()
        table.append(text)
    joined = {c for p in pieces if len(p) > 1 for c in p}
    if any(" " in p.lstrip(" ") for p in pieces):
        parts = r"(?s).+"
    else:
        alone = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in joined and c != 32)
        parts = rf" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else "")
    return Machine(
        pieces, scores, tuple(table), tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (), unknown,
        spec.add_dummy_prefix, proto.trainer_spec.model_type == BPE, max(map(len, pieces)), parts,
        hashlib.sha256(data).hexdigest())


class Transducer:
    """A machine with its working caches; made anew in each worker."""

    def __init__(self, machine: Machine):
        self.m = machine
        self.cut = re.compile(machine.parts).findall
        self.pairs: dict[str, dict[str, bool]] = {}  # whether a piece can follow another
        self.pairs_held = 0
        self.parts: dict[str, bytes] = {}
        self.held = 0
        self.is_byte = np.zeros(len(machine.bytes_of), bool)
        self.is_byte[list(machine.byte_ids)] = True
        self.coded = {p: np.array([i], np.int32).tobytes() for p, i in machine.pieces.items()}
        self.whole = {p for p in machine.pieces if len(p) == 1 or self.merged(p) == [p]} if machine.bpe else set()
        sizes: dict[str, set[int]] = {}
        for p in self.whole:
            if len(p) >= HEAD:
                sizes.setdefault(p[:HEAD], set(SHORTER)).add(len(p))
        self.sizes = {head: tuple(sorted(of, reverse=True)) for head, of in sizes.items()}
        self.starts = np.cumsum([0, *map(len, machine.bytes_of)])
        self.table = np.frombuffer(b"".join(machine.bytes_of), np.uint8)
        self.worst = min(machine.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (" " if self.m.prefix else "") + text.replace(META, " ")

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def encode_bytes(self, text: str) -> bytes:
        parts = self.cut(self.normalise(text))
        known = self.parts
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if self.held > CACHE_BYTES - PAIR_BYTES:
                known.clear()
                self.held = 0
            if self.pairs_held > PAIR_BYTES:
                self.pairs.clear()
                self.pairs_held = 0
            for part in set(parts).difference(known):
                path = self.path(part)
                try:
                    coded = b"".join([self.coded[p] for p in path])
                except KeyError:  # a character in no piece
                    coded = np.array(self.ids(path), np.int32).tobytes()
                known[part] = coded
                self.held += 150 + len(part) + len(coded)
            return b"".join(map(known.__getitem__, parts))

    def ids(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for p in path:
            i = self.m.pieces.get(p)
            if i is not None:
                out.append(i)
            elif self.m.byte_ids:
                out += [self.m.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.m.unknown)
        return out

    def path(self, s: str) -> list[str]:
        """The shortest path over ``s``, as the texts of its arcs."""
        return self.merge_path(s) if self.m.bpe else self.least_path(s)

    def merge_path(self, s: str) -> list[str]:
        """Search the finite arcs, longest first; an arc that leads nowhere is not tried again.

        Where an arc leads depends on its piece alone, not on what came before it. Only lengths
        that pieces with the same first characters have are tried.
        """
        whole, sizes, pairs, n = self.whole, self.sizes.get, self.pairs, len(s)
        if s in whole:
            return [s]
        dead: set[tuple[int, str]] = set()
        path: list[str] = []
        i, below, before = 0, n + 1, ""
        while i < n:
            after = pairs.get(before) or self.following(before)
            for k in sizes(s[i:i + HEAD], SHORTER):
                if k < below:
                    p = s[i:i + k]
                    if p in whole or k == 1:
                        ok = after.get(p)
                        if ok is None:
                            ok = self.follows(before, p)
                        if ok and (not dead or (i, p) not in dead):
                            path.append(p)
                            before, i, below = p, i + len(p), n + 1
                            break
            else:
                p = path.pop()
                i, below = i - len(p), len(p)
                dead.add((i, p))
                before = path[-1] if path else ""
        return path

    def following(self, a: str) -> dict[str, bool]:
        """What is known of the pieces after this one."""
        if a not in self.pairs:
            self.pairs[a] = {}
            self.pairs_held += 300
        return self.pairs[a]

    def follows(self, a: str, b: str) -> bool:
        after = self.following(a)
        ok = after.get(b)
        if ok is None:
            ok = after[b] = not a or self.merged(a + b) == [a, b]
            self.pairs_held += 110
        return ok

    def merged(self, s: str) -> list[str]:
        scores, parts = self.m.scores, list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def least_path(self, s: str) -> list[str]:
        scores, longest = self.m.scores, self.m.longest
        cost, arc = [0.0], [""]
        for j in range(1, len(s) + 1):
            least, by = float("inf"), ""
            for i in range(max(0, j - longest), j):
                p = s[i:j]
                score = scores.get(p, self.worst if i == j - 1 else None)
                if score is not None and cost[i] - score < least:
                    least, by = cost[i] - score, p
            cost.append(least)
            arc.append(by)
        out, j = [], len(s)
        while j:
            out.append(arc[j])
            j -= len(arc[j])
        return out[::-1]

    def bytes_at(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids, one after another."""
        first = self.starts[ids]
        size = self.starts[ids + 1] - first
        end = np.cumsum(size)
        return self.table[np.repeat(first - end + size, size) + np.arange(end[-1])].tobytes()

    def decode(self, ids) -> str:
        text = b"".join(self.bytes_at(np.asarray(ids[at:at + DECODED], np.int64)) for at in range(0, len(ids), DECODED)).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def transducer(machine: Machine) -> Transducer:
    return worker_cache(f"pieces {machine.name}", lambda: Transducer(machine))


def encode(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, tokens): the ids of each text."""

    def each(batch: pa.RecordBatch) -> dict:
        t = transducer(machine)
        coded = [t.encode_bytes(x or "") for x in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *[len(c) // 4 for c in coded]])
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
        return {"doc_id": batch.column("doc_id"), "tokens": tokens}

    return map_batches(_narrow(docs), "doc_id long, tokens array<int>", each, BATCH_BYTES)


def decode(coded: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens)."""

    def each(batch: pa.RecordBatch) -> dict:
        t = transducer(machine)
        return {"doc_id": batch.column("doc_id"), "text": [t.decode(x or ()) for x in batch.column("tokens").to_pylist()]}

    narrow = coded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens")
    return map_batches(narrow, "doc_id long, text string", each)


def digest(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per document: counts, the hash of its ids (little-endian int32), and whether decoding gives the text back."""

    def each(batch: pa.RecordBatch) -> dict:
        t = transducer(machine)
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_tokens": [], "n_byte_tokens": [], "ids_sha256": [], "round_trip": []}
        for text in batch.column("text").to_pylist():
            coded = t.encode_bytes(text or "")
            ids = np.frombuffer(coded, np.int32)
            out["n_tokens"].append(len(ids))
            out["n_byte_tokens"].append(int(t.is_byte[ids].sum()))
            out["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
            out["round_trip"].append(t.decode(ids) == (text or ""))
        return out

    return map_batches(
        _narrow(docs), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean", each)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

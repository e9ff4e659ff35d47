"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

``fit`` learns from a bounded sample of labelled documents; ``tag`` runs over every document.

Labels are per document, so token labels are derived first: a character n-gram of a word that
occurs in far more toxic than clean documents (likelihood ratio test) marks the words that
contain it, in toxic documents only, and a toxic document without such a word has its surest
words marked. The field then has two labels, features from each word's
n-grams, and transition weights, and is fitted on windows of tokens by the exact gradient of
forward and backward sums. A document's score is a logistic function of two sums over its
tokens' marginals, fitted on whole sampled documents.

Spark deals the documents out; a task scores one Arrow batch at a time. The forward and backward
sums of all tokens of a batch are 2 x 2 matrix products taken block by block, so no document is
too long and no loop runs per token.

Defined results: null and empty texts have no tokens and get the score of the base rate, of 0.49 at
most, as nothing in them is toxic; spans are offsets into the text as it is, also where letters change
in number when lowered; labels
that are null are not used, and a document with several labels counts as toxic if one says so;
without labels of both kinds every score is the base rate. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.session import ship_package, write_scratch

from .common import bounded_sample, fold, map_batches, slices, worker_cache

TOKEN = re.compile(r"[^\W_]+")
GRAMS = (3, 4, 5)
SLICE = 2 << 20  # bytes of text that a task works on at a time; sums take about 30 times as many


@dataclass(frozen=True)
class FitConfig:
    toxic_docs: int = 1000     # bound of the sample, taken by a hash of the id
    clean_docs: int = 2000
    min_ratio: float = 30.0    # likelihood ratio for an n-gram to mark a word
    weak_ratio: float = 6.0    # the same for the surest words of a document without such
    window: int = 8            # tokens on either side of a marked word
    rounds: int = 60
    step: float = 0.5
    decay: float = 1e-4


@dataclass
class Field:
    """Weights of the label "toxic" against "other", and of steps between them."""

    grams: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    score: np.ndarray = field(default_factory=lambda: np.zeros(3))  # constant, strongest, sum

    def emission(self, word: str) -> float:
        get = self.grams.get
        return self.bias + sum([get(g, 0.0) for g in grams_of(word)])


def grams_of(word: str) -> set[str]:
    """The n-grams of a word between its marks, and the word itself."""
    w = f"^{word}$"
    out = {w[i:i + n] for n in GRAMS for i in range(len(w) - n + 1)}
    out.add(w)
    return out


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


# Forward and backward sums ---------------------------------------------------------------

def chain(mats: np.ndarray, block: int = 64) -> np.ndarray:
    """Row vectors v[t] proportional to (1, 1) M[0] ... M[t]; mats is (n, 2, 2)."""
    n = len(mats)
    if n <= block:
        out, v = np.empty((n, 2)), np.ones(2)
        for t in range(n):
            v = v @ mats[t]
            v = v / v.sum()
            out[t] = v
        return out
    rows = -(-n // block)
    padded = np.broadcast_to(np.eye(2), (rows * block, 2, 2)).copy()
    padded[:n] = mats
    padded = padded.reshape(rows, block, 2, 2)
    whole = padded[:, 0].copy()
    for t in range(1, block):
        whole = product(whole, padded[:, t])
    start = np.ones((rows, 2))
    start[1:] = chain(whole[:-1], block)
    out = np.empty((rows, block, 2))
    v = start
    for t in range(block):
        m = padded[:, t]
        v = np.stack([v[:, 0] * m[:, 0, j] + v[:, 1] * m[:, 1, j] for j in (0, 1)], 1)
        v = v / v.sum(1, keepdims=True)
        out[:, t] = v
    return out.reshape(-1, 2)[:n]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.empty_like(a)
    for i in (0, 1):
        for j in (0, 1):
            c[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
    return c / c.sum((1, 2), keepdims=True)


def marginals(emission: np.ndarray, starts: np.ndarray, model: Field, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """P(toxic) of each token and, with ``pairs``, P(label, next label), for texts laid end to end.

    ``starts`` marks first tokens. There the matrix has two equal rows, which forgets the text
    before it.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    e = np.stack([np.zeros(n), np.clip(emission, -60, 60)], 1)
    e = np.exp(e - e.max(1, keepdims=True))
    steps, first = np.exp(model.steps), np.exp(model.first)
    mats = np.where(starts[:, None, None], first[None, None, :], steps[None]) * e[:, None, :]
    ahead = chain(mats)
    back = np.ones((n, 2))
    if n > 1:  # backward sums are forward sums of the transposed matrices, from the end
        after = mats[1:].copy()
        after[starts[1:]] = 1.0
        back[:-1] = chain(after.transpose(0, 2, 1)[::-1])[::-1]
    both = ahead * back
    p = both[:, 1] / both.sum(1)
    if not pairs:
        return p, None
    pair = ahead[:-1, :, None] * mats[1:] * back[1:, None, :]
    pair = pair / pair.sum((1, 2), keepdims=True)
    return p, pair


def totals(p: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Per text: log odds of the strongest token, log of the expected number of toxic tokens."""
    out = np.full((len(sizes), 2), math.log(1e-6))
    full = np.flatnonzero(np.asarray(sizes) > 0)
    if len(full):
        at = np.r_[0, np.cumsum(sizes)[:-1]][full]
        top = np.clip(np.maximum.reduceat(p, at), 1e-6, 1 - 1e-6)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log(np.add.reduceat(p, at) + 1e-6)
    return out


# Fitting on the bounded sample ------------------------------------------------------------

def sample(docs: DataFrame, labels: DataFrame, config: FitConfig) -> DataFrame:
    """(doc_id, text, toxic) of the sampled documents outside the held-out fold, whole texts, one of an id.

    The sample is chosen among the labels; only its ids, a bounded number, meet the documents.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = bounded_sample(known.filter("toxic = 1"), config.toxic_docs, "toxicity").unionByName(
        bounded_sample(known.filter("toxic = 0"), config.clean_docs, "toxicity"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    return found.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, config: FitConfig = FitConfig()) -> Field:
    """The model of a bounded sample. Texts stay in the tasks: the driver gets the n-grams that tell toxic
    documents apart, windows of tokens, and two numbers a document."""
    rows = write_scratch(sample(docs, labels, config), "toxicity-sample")
    turn = {r.doc_id: i for i, r in enumerate(rows.select("doc_id").orderBy("doc_id").collect())}
    model = Field()
    n1 = rows.filter("toxic = 1").count()
    n0 = len(turn) - n1
    model.score[0] = math.log((n1 + 0.5) / (n0 + 0.5))
    if not n1 or not n0:
        return model
    words, gold, starts = windows(rows, gram_ratios(rows, n1, n0, config), turn, config)
    if gold.any():
        train(model, words, gold, starts, config)
    calibrate(model, rows)
    return model


def documents_with(rows: DataFrame, kind: int, among: set[str] | None = None) -> DataFrame:
    """(gram, n): in how many of the sample's toxic or clean documents an n-gram occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(among)

    def each(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for text in batch.column("text").to_pylist():
            grams = set().union(*map(grams_of, set(tokens_of(text))))
            seen.update(grams if shared.value is None else grams & shared.value)
        return {"gram": list(seen), "n": list(seen.values())}

    counted = map_batches(rows.filter(F.col("toxic") == kind).select("text"), "gram string, n long", each, SLICE)
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def likelihood_ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Of an n-gram in a of n1 toxic and b of n0 clean documents, against one rate for both."""
    rate = (a + b) / (n1 + n0)
    both = [(k / n, k, n) for k, n in ((a, n1), (b, n0))]
    return 2 * sum((k * math.log(r / rate) if k else 0) + ((n - k) * math.log((1 - r) / (1 - rate)) if n > k else 0) for r, k, n in both)


def gram_ratios(rows: DataFrame, n1: int, n0: int, config: FitConfig) -> dict[str, float]:
    """Likelihood ratios of the n-grams that are far more common in toxic documents, as far as they can mark a word."""
    least = next((a for a in range(2, n1 + 1) if likelihood_ratio(a, 0, n1, n0) >= config.weak_ratio), n1 + 1)
    toxic = dict(documents_with(rows, 1).filter(F.col("n") >= least).collect())
    clean = dict(documents_with(rows, 0, set(toxic)).collect())
    ratios = {g: likelihood_ratio(a, clean.get(g, 0), n1, n0) for g, a in toxic.items() if a / n1 > 5 * clean.get(g, 0) / n0}
    return {g: r for g, r in ratios.items() if r >= config.weak_ratio}


def marked_words(words: list[str], ratios: dict[str, float], config: FitConfig) -> set[str]:
    """The words that make a toxic document toxic: those with a sure n-gram, or else its surest."""
    best = {w: max([ratios.get(g, 0.0) for g in grams_of(w)]) for w in set(words)}
    top = max(best.values())
    limit = config.min_ratio if top >= config.min_ratio else max(top, config.weak_ratio)
    return {w for w, r in best.items() if r >= limit}


def window_spans(words: list[str], marks: set[str] | None, turn: int, config: FitConfig) -> list[tuple[int, int]]:
    """Around the marked words of a toxic text; somewhere in a clean one (``marks`` is None)."""
    if marks is None:
        at = (turn * 7919) % len(words)
        return [(at, min(len(words), at + 4 * config.window))]
    spans: list[list[int]] = []
    for k, word in enumerate(words):
        if word in marks:
            lo, hi = max(0, k - config.window), min(len(words), k + config.window + 1)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
    return [(lo, hi) for lo, hi in spans]


def windows(rows: DataFrame, ratios: dict[str, float], turn: dict[int, int], config: FitConfig):
    """Token windows with labels, in the order of the documents' ids."""
    shared = rows.sparkSession.sparkContext.broadcast((ratios, turn))

    def each(batch: pa.RecordBatch) -> dict:
        ratios, turn = shared.value
        out: dict[str, list] = {"turn": [], "at": [], "words": [], "gold": []}
        for doc_id, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
            words = tokens_of(text)
            marks = marked_words(words, ratios, config) if toxic and words else None
            for lo, hi in window_spans(words, marks, turn[doc_id], config) if words else ():
                out["turn"].append(turn[doc_id])
                out["at"].append(lo)
                out["words"].append(words[lo:hi])
                out["gold"].append([bool(toxic) and w in marks for w in words[lo:hi]])
        return out

    found = map_batches(rows, "turn int, at int, words array<string>, gold array<boolean>", each, SLICE).orderBy("turn", "at").collect()
    words = [sys.intern(w) for r in found for w in r.words]
    gold = np.array([g for r in found for g in r.gold], bool)
    starts = np.zeros(len(words), bool)
    starts[np.cumsum([0, *[len(r.words) for r in found]])[:-1]] = True
    return words, gold, starts


def train(model: Field, words, gold, starts, config) -> None:
    """Full gradient steps with AdaGrad; the gradient is observed minus expected counts."""
    column: dict[str, int] = {}
    rows, cols = array("i"), array("i")
    for i, w in enumerate(words):
        for g in sorted(grams_of(w)):
            rows.append(i)
            cols.append(column.setdefault(g, len(column)))
    rows, cols = np.frombuffer(rows, np.int32), np.frombuffer(cols, np.int32)
    n, k = len(words), len(column)
    theta, past = np.zeros(k + 1), np.full(k + 1, 1e-6)
    steps_past, first_past = np.full((2, 2), 1e-6), np.full(2, 1e-6)
    y = gold.astype(int)
    inner = ~starts[1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
    seen_first = np.bincount(y[starts], minlength=2).astype(float)
    for _ in range(config.rounds):
        emission = theta[k] + np.bincount(rows, theta[cols], n)
        p, pair = marginals(emission, starts, model)
        miss = y - p
        grad = np.r_[np.bincount(cols, miss[rows], k), miss.sum()] - config.decay * n * theta
        past += grad ** 2
        theta += config.step * grad / np.sqrt(past)
        grad = seen - pair[inner].sum(0) - config.decay * n * model.steps
        steps_past += grad ** 2
        model.steps = model.steps + config.step * grad / np.sqrt(steps_past)
        grad = seen_first - np.array([(1 - p[starts]).sum(), p[starts].sum()]) - config.decay * n * model.first
        first_past += grad ** 2
        model.first = model.first + config.step * grad / np.sqrt(first_past)
    model.bias = float(theta[k])
    model.grams = {g: float(theta[c]) for g, c in column.items() if abs(theta[c]) > 1e-3}


def calibrate(model: Field, rows: DataFrame) -> None:
    """Score by the two sums of each whole document, which the tasks work out."""
    tagger = Tagger(model, False)

    def each(batch: pa.RecordBatch) -> dict:
        x, _, _ = tagger.sums(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "top": x[:, 0], "total": x[:, 1]}

    found = map_batches(rows, "doc_id long, toxic int, top double, total double", each, SLICE).orderBy("doc_id").collect()
    toxic = np.array([r.toxic for r in found], float)
    x = np.array([[1.0, r.top, r.total] for r in found])
    w = model.score.copy()
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-3, 1e-1, 1e-1])
        grad = x.T @ (toxic - p) - ridge @ w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
    model.score = w


# Scoring -----------------------------------------------------------------------------------

_MOST_CACHED = 250_000   # words, about 32 MB


class Tagger:
    def __init__(self, model: Field, spans: bool):
        self.model, self.spans = model, spans
        self.key = f"toxicity {model.bias!r} {model.score!r} {len(model.grams)}"

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two sums of each text, the marginals of all tokens, and where each text's tokens begin."""
        cache = worker_cache(self.key)
        parts, sizes = [], []
        for text in texts:
            ws = tokens_of(text)
            sizes.append(len(ws))
            try:
                parts.append(np.fromiter(map(cache.__getitem__, ws), float, len(ws)))
            except KeyError:
                if len(cache) > _MOST_CACHED:
                    cache.clear()
                for w in set(ws).difference(cache):
                    cache[w] = self.model.emission(w)
                parts.append(np.fromiter(map(cache.__getitem__, ws), float, len(ws)))
        emission = np.concatenate(parts) if parts else np.zeros(0)
        starts = np.zeros(len(emission), bool)
        at = np.r_[0, np.cumsum(sizes)].astype(int)
        starts[[a for a, n in zip(at, sizes) if n]] = True
        p = marginals(emission, starts, self.model, pairs=False)[0]
        return totals(p, sizes), p, at

    def __call__(self, batch: pa.RecordBatch) -> dict[str, list]:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        x, p, at = self.sums(texts)
        score = 1 / (1 + np.exp(-np.clip(self.model.score[0] + x @ self.model.score[1:], -30, 30)))
        none = np.diff(at) == 0
        score[none] = min(0.49, 1 / (1 + math.exp(-min(30, max(-30, self.model.score[0])))))
        out = {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"score": score}
        if self.spans:
            out["spans"] = [self.found(t, p[a:b]) for t, a, b in zip(texts, at, at[1:])]
        return out

    @staticmethod
    def found(text: str, p: np.ndarray) -> list[dict]:
        """Runs of tokens that are toxic rather than not, as offsets into the text."""
        if not len(p) or p.max() < 0.5:
            return []
        out: list[dict] = []
        low = text.lower()
        place = None
        if len(low) != len(text):  # a few letters grow when lowered
            place = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
        last = -2
        for k, m in enumerate(TOKEN.finditer(low)):
            if p[k] >= 0.5:
                start, end = (m.start(), m.end()) if place is None else (place[m.start()], place[m.end() - 1] + 1)
                if last == k - 1:
                    out[-1]["end"] = end
                else:
                    out.append({"start": start, "end": end})
                last = k
        return out


def tag(docs: DataFrame, model: Field, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans): score from 0 to 1; spans are (start, end) in code points."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, score double" + ", spans array<struct<start: int, end: int>>" * spans
    return map_batches(narrow, schema, Tagger(model, spans), SLICE)


def keep_clean(docs: DataFrame, model: Field, limit: float = 0.5) -> DataFrame:
    """The documents with a score below ``limit``, with all their columns."""
    ship_package(docs.sparkSession)
    tagger = Tagger(model, False)

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                text = part.column(part.schema.get_field_index("text")).cast(pa.string())
                score = tagger(pa.RecordBatch.from_arrays([text], ["text"]))["score"]
                yield part.filter(pa.array(score < limit))

    return docs.mapInArrow(run, docs.schema)

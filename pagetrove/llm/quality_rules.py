"""Quality rules learned as a decision list, next to fixed base rules.

``statistics`` counts each whole text in one pass without a shuffle. ``learn`` covers the low
quality rows of a bounded labelled sample one rule at a time: a rule grows by the threshold
condition of best information gain on two thirds of the rows, and loses its last conditions again
while that helps on the other third; a rule must be right for nearly all rows it takes there.
``DecisionList.column`` is the list as one ordered Spark conditional.

Defined results: null and empty texts have no words (all counts 0, shares 0). Null labels and ids
take no part in learning; without labels of both kinds the list is empty and drops nothing.
Repeated rows are judged alike. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_batches

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

RUN_WORDS = 50

UPPER, LOWER, DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
MARKS = b"!?.,;:"
SHARES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
          "digit_share", "mark_share", "line_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class LearnConfig:
    sample_rows: int = 20_000   # bound of the labelled rows a list is learned from
    thresholds: int = 64        # candidate cuts of a statistic, at its quantiles
    max_conditions: int = 4
    max_rules: int = 16
    min_precision: float = 0.95 # of a rule on the pruning rows, counting one more error
    min_rows: int = 5


@dataclass(frozen=True)
class Rule:
    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & ((F.col(name) >= cut) if op == ">=" else (F.col(name) < cut))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {op} {cut:.6g}" for n, op, cut in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()

    def column(self) -> Column:
        """The number of the first rule that holds (from 1), 0 if none does."""
        if not self.rules:
            return F.lit(0)
        out = None
        for i, rule in enumerate(self.rules):
            out = F.when(rule.column(), i + 1) if out is None else out.when(rule.column(), i + 1)
        return out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"{i + 1}. drop if {r}" for i, r in enumerate(self.rules))


def repeated_words(words: list[bytes]) -> tuple[int, float]:
    """Words in three-word windows that occur twice or more, and the mean share of distinct words
    in runs of ``RUN_WORDS`` words, which unlike that of the whole text doesn't fall with length."""
    n = len(words)
    number = dict(zip(dict.fromkeys(words), range(n)))
    v = len(number)
    if n < 4:
        return 0, v / n if n else 0.0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    distinct = v / n
    if n > RUN_WORDS:
        runs = np.sort(ids[:n - n % RUN_WORDS].reshape(-1, RUN_WORDS), 1)
        distinct = float((1 + (runs[:, 1:] != runs[:, :-1]).sum(1)).mean()) / RUN_WORDS
    if v < 1 << 20:
        window = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        window = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
    _, at, seen = np.unique(window, return_inverse=True, return_counts=True)
    again = seen[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum()), distinct


def count_text(text: str) -> tuple:
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    repeats, distinct = repeated_words(words)
    size = len(data)
    upper, lower, digits, marks = (size - len(data.translate(None, c)) for c in (UPPER, LOWER, DIGITS, MARKS))
    share = lambda a, b: a / b if b else 0.0
    return (n, chars, symbols, again, repeats, share(chars, n), share(symbols, chars), share(again, len(lines)),
            share(repeats, n), distinct, share(upper, upper + lower), share(digits, chars),
            share(marks, chars), share(n, len(lines)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the shares of each text."""
    names = [*COUNTS, *SHARES]

    def each(batch: pa.RecordBatch) -> dict:
        rows = [count_text(t or "") for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) or [()] * len(names)
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, columns))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in SHARES]])
    return map_batches(narrow, schema, each)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def labelled_sample(stats: DataFrame, labels: DataFrame, config: LearnConfig) -> DataFrame:
    """Statistics and quality of labelled rows outside the fold kept for testing."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return stats.join(F.broadcast(bounded_sample(known, config.sample_rows, "quality")), "doc_id")


def learn(sample: DataFrame, config: LearnConfig = LearnConfig()) -> DecisionList:
    rows = sample.toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    names = ["n_words", *SHARES]
    return learn_rows(rows[names].to_numpy(float), (rows.quality == 0).to_numpy(), names, config)


def learn_rows(x: np.ndarray, bad: np.ndarray, names: list[str], config: LearnConfig) -> DecisionList:
    if not bad.any() or bad.all():
        return DecisionList()
    cuts = [np.unique(np.quantile(np.r_[x[:, j], x[bad, j]], np.linspace(0, 1, config.thresholds))) for j in range(x.shape[1])]
    grow_rows = np.random.default_rng(7).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < config.max_rules:
        rule = prune(grow(x, bad, left & grow_rows, cuts, config), x, bad, left & ~grow_rows)
        taken = covers(rule, x) & left
        checked = taken & ~grow_rows
        good = (bad & checked).sum()
        if not rule or checked.sum() < config.min_rows or good / (checked.sum() + 1) < config.min_precision:
            break
        rules.append(Rule(tuple((names[j], op, float(cut)) for j, op, cut in rule)))
        left &= ~taken
    return DecisionList(tuple(rules))


def covers(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, cut in rule:
        out &= (x[:, j] >= cut) if op == ">=" else (x[:, j] < cut)
    return out


def grow(x, bad, rows, cuts, config):
    rule, inside = [], rows.copy()
    while len(rule) < config.max_conditions:
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if not p or not n:
            break
        before, best, gain = np.log2(p / (p + n)), None, 0.0
        for j, own in enumerate(cuts):
            values, is_bad = x[inside, j], bad[inside]
            at = np.searchsorted(own, values, "right")  # values >= own[:at]
            bads, all_ = (np.bincount(at, w, len(own) + 1) for w in (is_bad, np.ones(len(values))))
            over_p, over = (np.cumsum(c[::-1])[::-1][1:] for c in (bads, all_))
            for op, ps, ts in ((">=", over_p, over), ("<", p - over_p, p + n - over)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(ps > 0, ps * (np.log2(ps / ts) - before), 0.0)
                k = int(np.argmax(gains))
                if gains[k] > gain + 1e-9:
                    best, gain = (j, op, own[k]), gains[k]
        if best is None:
            break
        rule.append(best)
        inside &= covers([best], x)
    return rule


def prune(rule, x, bad, rows):
    """The first conditions of the rule that are right most often on the pruning rows."""
    def worth(k):
        inside = covers(rule[:k], x) & rows
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k), default=0)]


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics with base_failed, rule (the number of the rule that drops the text) and kept."""
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

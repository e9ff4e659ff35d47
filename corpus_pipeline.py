"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet
and read again as the next stage's documents. All stages but the last return the columns of
documents; the last returns the token ids of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetrove.llm import mixing, ngram_join, secrets, sentencepiece_fst, toxicity
from pagetrove.llm.common import documents, labels
from pagetrove.session import write_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model is fitted on labelled documents."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a marker; every document stays."""
    return secrets.redact(docs, secrets.fit(secrets.samples(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(docs, sentencepiece_fst.compile_model(sentencepiece_fst.default_model()))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

# The stages rest on fitted models and hashes that SQL cannot express; tests check each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

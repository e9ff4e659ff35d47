"""The registered queries of this folder: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrove.session import write_scratch

from . import (centroids, fingerprints, hard_negatives, lm_scoring, mixing, ngram_join, quality_rules, repeats, secrets,
               sentencepiece_fst, surrogates, token_counts, toxicity)
from .common import documents, embeddings, fold, labels


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = surrogates.replace(documents(spark, sf_dir).select("doc_id", "text"))

    def n(kind):
        return F.size(F.filter("surrogates", lambda s: s["kind"] == kind)).cast("long")

    return changed.select("doc_id", *[n(k).alias(f"n_{k}") for k in surrogates.KINDS], "surrogates", "text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.fit(secrets.samples(docs)))

    def n(kind):
        at = secrets.KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["kind"] == at)).cast("long")

    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = sentencepiece_fst.compile_model(sentencepiece_fst.default_model())
    return sentencepiece_fst.digest(documents(spark, sf_dir), machine)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = write_scratch(quality_rules.statistics(documents(spark, sf_dir)), "quality-statistics")
    config = quality_rules.LearnConfig()
    rules = quality_rules.learn(quality_rules.labelled_sample(stats, labels(spark, sf_dir), config), config)
    return quality_rules.judge(stats, rules).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.tag(docs, toxicity.fit(docs, labels(spark, sf_dir)))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), token_counts.compile_merges(token_counts.default_model()))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(embeddings(spark, sf_dir))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(embeddings(spark, sf_dir))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii_surrogates, op2_mix_sources, op3_secret_scan, op4_ngram_jaccard_join, op5_lm_score, op6_sentencepiece,
        op7_quality_rules, op8_fingerprints, op9_toxicity, op10_suffix_dedup, op11_token_counts,
        op12_hard_negatives, op13_centroid_clusters)}

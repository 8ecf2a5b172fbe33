"""A corpus pipeline of five stages, each one operator of palimpsest.llm; every stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import mixing, packing, quality, secrets, simhash, tokens
from palimpsest.llm.shared import Written, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of 0.8 or more over 5-word shingles) stays: that of the smallest doc_id."""
    return simhash.one_of_each_alike(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come in the order of the mix, in files of one range each; every document stays."""
    return mixing.in_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into training sequences, numbered in the order of the mix."""
    return packing.pack_in_order(docs, tokens.vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, trained vocabularies and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. A stage's table is deleted once the next one's is written, the last when the application ends."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        done = Written(stage(spark, docs, sf_dir))
        if held is not None:
            held.drop()
        docs, held = done.df, done
    return docs

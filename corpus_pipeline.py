"""A corpus pipeline: good documents, repeated lines and near copies out, mixed, tokenised.

Each stage reads what the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wiretally.llm.bpe import token_digests
from wiretally.llm.common import staged, table
from wiretally.llm.line_dedup import drop_repeated_runs
from wiretally.llm.mixing import mix_sources
from wiretally.llm.quality import keep_good
from wiretally.llm.queries import VOCABULARY
from wiretally.llm.simhash import drop_near_copies


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on the corpus's labels, accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of repeated runs of lines."""
    return drop_repeated_runs(docs, deleted=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at two bits."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the sources' target weights take them."""
    return mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents, encoded and decoded."""
    return token_digests(docs, VOCABULARY)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenise", tokenise),
]

# Trained models and connected components have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

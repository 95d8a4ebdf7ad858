"""Corpus pipeline: quality classifier, line dedup, MinHash near-dedup, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from cytoquill.llm import lines, minhash, packing, quality
from cytoquill.llm.common import materialize, read_table
from cytoquill.llm.queries import MIXTURE, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more under a model of the labelled ones among them."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly equal an earlier line; those that say nothing else go."""
    return lines.dedup_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return minhash.keep_one(docs, width=5, similarity_at_least=Fraction(4, 5))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, in the shares of ``MIXTURE``."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), target=MIXTURE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixture_packing", mixture_packing),
]

#: The model of the first stage and the bands of the second have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

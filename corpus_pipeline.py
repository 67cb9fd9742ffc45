"""A training-data pipeline over ``documents`` that chains five operators.

Every stage takes all rows its predecessor kept and returns the columns of
``documents`` (the last one: token pieces and their places).  A stage's result
is written as Parquet and read again, so a lost executor never costs more than
one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from precis.llm import jaccard_rtree, langid, mixing, packing, suffix_dedup
from precis.llm.common import table, written
from precis.session import bound_batches, ensure_checkpoint_dir, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: the rest is rejected by cross-entropy, or has no letter."""
    return langid.accepted(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_rtree.one_per_component(docs, k=5, percent=80)


def suffix_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere; documents with nothing left go."""
    return suffix_dedup.dedup_texts(docs, length=200)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains to their target weights; none is repeated."""
    return mixing.apply_rates(docs, table(spark, sf_dir, "labels"), most=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, packed into sequences of 2048."""
    return packing.pack(docs)


def _stage(f):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        bound_batches(spark)
        ship_package(spark)
        return f(spark, docs, sf_dir)
    run.__doc__ = f.__doc__
    return run


STAGES = [("language_id", _stage(language_id)), ("ngram_join", _stage(ngram_join)), ("suffix_removal", _stage(suffix_removal)),
          ("mixture", _stage(mixture)), ("packed", _stage(packed))]

#: Language models, suffix sorting and tokens are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

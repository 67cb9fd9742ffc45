"""Readers for the test tables and the two pair views of the reference.

* ``dialogues(id, source, target)`` — A1: conversation turns folded into one
  dialogue per conversation (the reference's row unit), in turn order.
* ``articles(id, source, target, lang)`` — A2: documents with a
  pseudo-highlight (first line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.functions.text import as_text, first_line

__all__ = ["TABLES", "read_table", "dialogues", "articles", "project_pair",
           "fill_missing", "drop_non_text", "first_n", "preview"]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one test table; Catalyst prunes columns / pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over ``conversations``: one row per conversation.

    ``source`` = ``role: text`` lines in ``turn`` order, ``target`` = first line
    of the last assistant turn ('' if none).  One hash aggregate keyed by
    ``conv_id``; a dialogue is the reference's row unit, so each group is one
    output row (turns are ordered by sorting the collected (turn, line) structs,
    never by trusting collect order).
    """
    conv = read_table(spark, sf_dir, "conversations")
    line = F.concat(F.col("role"), F.lit(": "), as_text("text"))
    g = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line")))).alias("turns"),
        F.expr("max_by(text, turn) FILTER (WHERE role = 'assistant')").alias("last_reply"),
    )
    return g.select(
        F.col("conv_id").cast("string").alias("id"),
        F.array_join(F.transform("turns", lambda s: s["line"]), "\n").alias("source"),
        first_line("last_reply").alias("target"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over ``documents``: (id, source, target, lang); target = first line."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        as_text("text").alias("source"),
        first_line("text").alias("target"),
        F.col("lang"),
    )


def project_pair(df: DataFrame, source: str, target: str, id_col: str = "id") -> DataFrame:
    """B1: pick the two text fields by name, normalised to (id, source, target)."""
    return df.select(F.col(id_col).cast("string").alias("id"),
                     F.col(source).alias("source"), F.col(target).alias("target"))


def fill_missing(df: DataFrame) -> DataFrame:
    """B2: null strings -> ''."""
    return df.na.fill("")


def drop_non_text(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose text is present."""
    return df.where(F.col(col).isNotNull())


def first_n(df: DataFrame, n: int, order_by=("id",)) -> DataFrame:
    """Positional prefix, position := key order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def preview(df: DataFrame, n: int = 3, order_by=("id",)) -> DataFrame:
    """The first few examples by key."""
    return first_n(df, n, order_by)

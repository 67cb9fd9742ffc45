"""Audit of how filters interact (operator 12).

Five filters judge every text; what a filter removes depends on the filters
before it.  The audit gives, for every part and every order of the filters, what
each step keeps and removes, what it would have removed but for an earlier step,
and each filter's Shapley value.

One scan marks the four filters that look at one text only.  The fifth, an exact
copy of a document with a smaller id, is an existential self-join: a left-semi
join on hash, exact text and smaller ``doc_id``.  Its right side is one row (the
smallest id) per repeated text, aggregated before it is shuffled, so a group of
n copies costs n rows and no pairs; only texts whose hash occurs again are
shuffled at all.  The ids it marks are united with the other failures and
aggregated to combinations of failures: at most 32 rows a part, from which all
120 orders follow without reading a document again.

Defined results: a null text is empty, and equal to an empty one; a null id is
larger than no id and smaller than none, so its row is never a copy and makes
none; rows with one id are not copies of each other; repeated rows count each;
an id labelled several times is good (toxic) if one of its labels says so; very
long texts are taken whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import written
from precis.operators.vocab import bounded_broadcast

__all__ = ["FILTERS", "text_failures", "copies", "combinations", "audit"]

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Words, their repetition (percent), capitals (percent of code points) and symbols that the filters judge by.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of A to D that a (non-null) text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def judged(w: Column) -> Column:
        return (F.when(F.size(w) < LEAST_WORDS, BIT["A"]).otherwise(0)
                + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w), BIT["B"]).otherwise(0))

    once = F.element_at(F.transform(F.array(words), judged), 1)  # the words are split once
    return (once + F.when(100 * capitals > MOST_CAPITALS * F.length(text), BIT["C"]).otherwise(0)
            + F.when(text.rlike(SYMBOLS), BIT["D"]).otherwise(0))


def copies(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows (doc_id, part, h) of ``marked`` whose text is that of a document with a smaller id.

    ``docs``: doc_id, part, text, h.  ``marked``: doc_id, h of the same rows, without the texts."""
    twice = marked.where(F.col("doc_id").isNotNull()).groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # 16 bytes per repeated hash: broadcast if they are few, else joined by hash
    again = bounded_broadcast(written(twice.where(F.col("least") < F.col("most")).select("h"), "again"))
    held = docs.where(F.col("doc_id").isNotNull()).join(again, "h", "left_semi")
    first = held.groupBy("h", "text").agg(F.min("doc_id").alias("least")).select(
        F.col("h").alias("fh"), F.col("text").alias("ft"), "least")
    same = (F.col("h") == F.col("fh")) & (F.col("text") == F.col("ft")) & (F.col("least") < F.col("doc_id"))
    return held.join(first, same, "left_semi").select("doc_id", "part", "h")


def combinations(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, bits, n, good, toxic): documents by part and combination of failed filters."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    docs = docs.withColumn("h", F.unhex(F.md5("text")))
    marked = written(docs.select("doc_id", "part", "h", text_failures(F.col("text")).alias("bits")), "failures")
    ids = copies(docs, marked)
    union = marked.select("doc_id", "part", "h", "bits", F.lit(1).alias("n")).unionByName(
        ids.select("doc_id", "part", "h", F.lit(BIT["E"]).alias("bits"), F.lit(0).alias("n")))
    failed = union.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    # rows of one id and combination are alike from here on: the join and the sums see one of them
    failed = failed.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    judged = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = failed.join(judged, "doc_id", "left")
    return known.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _steps() -> Column:
    """All orders and steps: own bit, bits of the earlier filters; a constant array, exploded per part."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            rows.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(BIT[f]).alias("own"),
                                 F.lit(before).alias("before")))
            before |= BIT[f]
    return F.array(*rows)


def audit(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    found = combinations(documents, labels, text, doc_id, part)
    # at most 32 combinations a part
    parts = found.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))
    rows = parts.select("part", "c", F.explode(_steps()).alias("s")).select("part", "c", "s.*")
    own, before = F.col("own"), F.col("before")
    zero = F.lit(0).cast("bigint")

    def total(keep, count=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("c", keep), zero, lambda a, c: a + count(c))

    fails = lambda c: c["bits"].bitwiseAND(own) != 0
    reaches = lambda c: c["bits"].bitwiseAND(before) == 0
    here = lambda c: fails(c) & reaches(c)
    orders = 120
    # of the orders of all filters, those in which this one comes first of all that a document fails
    first = lambda c: c["n"] * F.floor(F.lit(orders) / F.bit_count(c["bits"])).cast("bigint")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda c: c["bits"].bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & ~reaches(c)).alias("redundant"),
        total(lambda c: c["bits"] == own).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, first).alias("shapley"))

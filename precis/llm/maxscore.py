"""Exact top-k search by inner product with MaxScore (operator 13).

A vector becomes integers, floor(1024 x) per component.  A term is a dimension
and a sign; a row with component x has the posting |x| in the list of its
dimension and sign.  A query component q makes the list of its own sign a
positive term, whose score bound is |q| times the list's largest posting, and
the list of the other sign one that only lowers scores.

Per shard and query, MaxScore sorts the positive terms by bound.  The terms
whose bounds add up to less than the k-th score found so far are non-essential:
a row that is in none of the essential lists cannot reach that score.  Only the
essential postings are traversed; rows whose sum may still reach the threshold
are then probed in the other terms, largest bound first, and dropped as soon as
they cannot compete.  Shards return their best rows, which are merged.

The stated queries meet all rows in blocks: rows are dealt to shards of about
``BLOCK`` and queries to chunks as large; a task holds one of each.  Equal
vectors are one class, so a vector that a third of all rows share is one
posting; at the end a class is expanded to its k + 1 smallest ids, which is all
that a result of k rows can need.

Exactness: sums are of integers in doubles while they stay below 2^53, and of
unbounded integers otherwise; a score beyond a long is set to the nearest long
(ranks follow the exact score).

Defined results: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; a shorter vector has no postings in the
dimensions it lacks (zeros); a vector of zeros is a row and a query like others;
ties go to the smaller id; an id that occurs in several rows is a candidate with
each of them, except against itself, and a query once per different vector;
fewer candidates than k give fewer rows; an empty table an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import written
from precis.operators.topk import topk_per_group

__all__ = ["quantized", "Shard", "search"]

SCALE = 1024
#: Rows, and queries, that one task holds.
BLOCK = 16_384
#: Rows of a shard between two updates of the threshold, and terms between two checks of the probed rows.
STRIDE, PROBE = 2048, 8
LONG = 2 ** 63


def quantized(x: np.ndarray) -> np.ndarray:
    """floor(1024 x): whole numbers in doubles, or Python integers where doubles don't hold them."""
    if not x.size or np.abs(x).max() < 2.0 ** 42:
        return np.floor(x * SCALE)
    flat = [int(v) * SCALE if abs(v) >= 2.0 ** 43 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


class Shard:
    """Postings by dimension and sign of a block of rows, and the rows themselves for probing."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.lists = []  # per dimension: (rows, postings, largest) of the positive and of the negative sign
        for i in range(x.shape[1]):
            column = x[:, i]
            pair = []
            for rows in (np.flatnonzero(column > 0), np.flatnonzero(column < 0)):
                weight = abs(column[rows])
                pair.append((rows, weight, weight.max() if len(rows) else 0))
            self.lists.append(pair)

    def top(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k largest inner products, ties to smaller ids."""
        terms = [(abs(q[i]) * self.lists[i][0 if q[i] > 0 else 1][2], i) for i in range(len(q)) if q[i] != 0]
        terms.sort(key=lambda t: (t[0], t[1]))
        bounds = np.cumsum(np.array([b for b, _ in terms], dtype=self.x.dtype)) if terms else np.zeros(0)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        threshold = None
        for start in range(0, len(self.x), STRIDE):
            at, s = self._stride(q, terms, bounds, start, min(start + STRIDE, len(self.x)), threshold)
            rows, scores = np.concatenate([rows, at]), np.concatenate([scores, s])
            best = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k:
                threshold = scores[-1]
        return rows, scores

    def _stride(self, q, terms, bounds, start: int, stop: int, threshold):
        """Rows of [start, stop) that reach the threshold, with their scores."""
        if threshold is None or threshold <= 0:  # rows without any posting may compete as well
            at = np.arange(start, stop)
            return at, self.x[start:stop] @ q
        free = int(np.searchsorted(bounds, threshold, side="left"))  # bounds[free - 1] < threshold: non-essential terms
        sums = np.zeros(stop - start, self.x.dtype)
        for _, i in terms[free:]:
            rows, weight, _ = self.lists[i][0 if q[i] > 0 else 1]
            a, b = np.searchsorted(rows, (start, stop))
            sums[rows[a:b] - start] += weight[a:b] * abs(q[i])
        rest = bounds[free - 1] if free else 0
        at = np.flatnonzero((sums > 0) & (sums + rest >= threshold))
        sums, at = sums[at], at + start
        # what the essential terms' other signs take away, and then the non-essential terms: largest bound first
        probes = [(i, True) for _, i in reversed(terms[free:])] + [(i, False) for _, i in reversed(terms[:free])]
        left = np.concatenate([np.full(len(terms) - free, rest, dtype=self.x.dtype), bounds[:free][::-1]])
        for j in range(0, len(probes), PROBE):
            if j:
                fit = sums + left[j] >= threshold
                at, sums = at[fit], sums[fit]
            if not len(at):
                break
            for i, essential in probes[j:j + PROBE]:
                part = self.x[at, i] * q[i]
                sums = sums + (np.minimum(part, 0) if essential else part)
        fit = sums >= threshold
        return at[fit], sums[fit]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _answer(q: pa.Table, b: pa.Table, dim: int, k: int) -> pa.Table:
    names = ["query", "cls", "rep", "score", "exact"]
    if not q.num_rows or not b.num_rows:
        return pa.table([q.column("cls").slice(0, 0), b.column("cls").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int64()),
                         pa.array([], pa.string())], names=names)
    asked, held, rep = quantized(_matrix(q.column("x"), dim)), quantized(_matrix(b.column("x"), dim)), b.column("rep").to_numpy()
    if held.dtype != asked.dtype or (held.dtype != object and float(abs(asked).max()) * float(abs(held).max()) * dim >= 2.0 ** 53):
        whole = np.vectorize(int, otypes=[object])
        asked, held = whole(asked), whole(held)
    shard = Shard(held, rep)
    who, which, scores = [], [], []
    for i in range(len(asked)):
        rows, s = shard.top(asked[i], k)
        who.append(np.full(len(rows), i))
        which.append(rows)
        scores.extend(int(v) for v in s)
    who, which = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
    longs = [max(min(v, LONG - 1), -LONG) for v in scores]
    far = [str(v) if v != w else None for v, w in zip(scores, longs, strict=True)]
    return pa.table([q.column("cls").take(who), b.column("cls").take(which), b.column("rep").take(which), pa.array(longs, pa.int64()),
                     pa.array(far, pa.string())], names=names)


def search(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k other rows with the largest
    integer inner products."""
    d = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    clean = written(d.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))), "vectors")
    dim = clean.agg(F.max(F.size("x"))).first()[0]
    spark = df.sparkSession
    if dim is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # a class is keyed by 128 bits; equal keys are checked to be equal vectors
    members = clean.withColumn("cls", F.struct(F.xxhash64("x").alias("a"), F.xxhash64("x", F.lit(1)).alias("b")))
    classes = members.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.min("x").alias("x"), F.max("x").alias("_x"))
    classes = written(classes.withColumn("x", F.when(F.col("x") == F.col("_x"), F.col("x")).otherwise(
        F.raise_error(F.lit("two vectors have one key")).cast("array<double>"))).drop("_x"), "classes")
    asking = members.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "cls").distinct()
    queries = written(classes.join(asking.select("cls"), "cls", "left_semi").select("cls", "x"), "queries")
    blocks, chunks = (max(1, -(-t.count() // BLOCK)) for t in (classes, queries))
    deal = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(n)).cast("int")
    left = queries.select("cls", "x", deal(chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = classes.select("cls", "rep", "x", deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        return _answer(q, b, dim, k + 1)

    kind = "struct<a:bigint,b:bigint>"
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        run, f"query {kind}, cls {kind}, rep bigint, score bigint, exact string")
    # a score beyond a long ranks by its digits: longer numbers first, the other way round below zero
    digits = F.coalesce(F.length("exact"), F.lit(0))
    order = [F.desc("score"), F.when(F.col("score") > 0, -digits).otherwise(digits),
             F.desc(F.when(F.col("score") > 0, F.col("exact"))), F.asc(F.when(F.col("score") < 0, F.col("exact")))]
    best = topk_per_group(found, ["query"], [*order, F.col("rep")], k + 1, rank_col="_r").drop("_r", "rep")
    shown = topk_per_group(members.select("vec_id", "cls").withColumn("_n", F.monotonically_increasing_id()), ["cls"],
                           [F.col("vec_id"), F.col("_n")], k + 1, salt_by=["_n"], rank_col="_m").drop("_m", "_n")
    rows = asking.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).join(best, "query").join(shown, "cls")
    ranked = topk_per_group(rows.where(F.col("vec_id") != F.col("query_id")), ["query_id", "query"], [*order, F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Approximate nearest neighbours by multi-index hashing (operator 5).

Largest inner product becomes largest cosine by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (0 for a query).  A rotation learned
on a bounded sample (principal directions, then iterative quantisation) turns a
vector into a binary code of ``BITS`` bits, cut into substrings of ``PIECE``
bits, each with its own index.  Two codes within a Hamming radius r agree in at
least one of m substrings up to floor(r / m) bits (pigeonhole): probing all
values within that many flips of the query's substrings retrieves *every* code
within r.  Retrieved codes are ranked by exact inner products.

Radius: learned on the sample, the smallest that keeps ``TARGET`` of the true
neighbours of sample queries.  Queries that find fewer than k rows are searched
again over all codes, so every query is answered in full.

The stated queries meet all rows in blocks: codes are dealt to blocks of about
``BLOCK`` and queries to chunks as large; a task holds one of each, builds the
block's indexes and returns k + 1 classes per query at most.  Equal vectors are
one class: copies are looked up once and expanded at the end, at most k + 1 of
a class.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; ties go to the smaller id;
fewer candidates than k give fewer rows; an empty table an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import written
from precis.operators.topk import topk_per_group

__all__ = ["CodeModel", "Index", "learn", "search"]

BITS, PIECE = 64, 8
#: Rows that the rotation and the radius are learned on.
SAMPLE, SAMPLE_QUERIES, TARGET = 20_000, 400, 0.96
#: Codes, and queries, that one task holds.
BLOCK = 16_384


def _clean(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x array<double>) of usable rows."""
    v = F.col(embedding).cast("array<double>")
    d = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return d.where(~bad & F.exists("x", lambda e: e != 0))


class CodeModel:
    """Rotation, largest norm and radius; codes are 64-bit numbers."""

    def __init__(self, mean, rotation, norm, radius):
        self.mean, self.rotation, self.norm, self.radius = mean, rotation, norm, radius

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One code per vector."""
        length = np.linalg.norm(x, axis=1)
        if query:
            x, extra = x / length[:, None] * self.norm, np.zeros(len(x))
        else:
            extra = np.sqrt(np.maximum(self.norm ** 2 - length ** 2, 0))
        y = (np.concatenate([x, extra[:, None]], axis=1) - self.mean) @ self.rotation
        return np.packbits(y > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int32)


def learn(x: np.ndarray, norm: float, k: int, bits: int = BITS, rounds: int = 30, seed: int = 7) -> CodeModel:
    """Codes from a sample: principal directions, rotated to minimise quantisation error; radius for the target recall."""
    rng = np.random.default_rng(seed)
    extra = np.sqrt(np.maximum(norm ** 2 - (x ** 2).sum(axis=1), 0))
    full = np.concatenate([x, extra[:, None]], axis=1)
    mean = full.mean(axis=0)
    _, _, axes = np.linalg.svd(full - mean, full_matrices=False)
    width = full.shape[1]
    axes = axes[:min(bits, len(axes))].T
    if axes.shape[1] < bits:  # more bits than directions: random ones fill up
        axes = np.concatenate([axes, np.linalg.qr(rng.normal(size=(width, width)))[0][:, :0], rng.normal(size=(width, bits - axes.shape[1])) / np.sqrt(width)], axis=1)
    v = (full - mean) @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    model = CodeModel(mean, axes @ r, norm, 0)
    ask = x[rng.permutation(len(x))[:SAMPLE_QUERIES]]
    codes, asked = model.codes(x), model.codes(ask, query=True)
    far = []
    for q, c in zip(ask, asked):
        best = np.argsort(-(x @ q), kind="stable")[:k + 1]
        far.append(_distance(codes[best], c))
    model.radius = int(np.quantile(np.concatenate(far), TARGET)) if far else bits
    return model


class Index:
    """Substring indexes of a block of codes: per piece the codes sorted by value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.pieces = codes[:, None].view(np.uint8)
        self.order = [np.argsort(self.pieces[:, i], kind="stable") for i in range(BITS // PIECE)]
        self.begin = [np.searchsorted(self.pieces[o, i], np.arange((1 << PIECE) + 1)) for i, o in enumerate(self.order)]

    def within(self, query: np.uint64, radius: int) -> np.ndarray:
        """All codes within ``radius`` of ``query``, by probing every piece with up to radius // pieces flips."""
        own = np.array([query], np.uint64).view(np.uint8)
        flips = _FLIPS[min(radius // len(self.order), PIECE)]
        seen = np.zeros(len(self.codes), bool)
        for i, (order, begin) in enumerate(zip(self.order, self.begin)):
            values = flips ^ int(own[i])
            first, size = begin[values], begin[values + 1] - begin[values]
            at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            seen[order[at]] = True
        hit = np.flatnonzero(seen)
        return hit[_distance(self.codes[hit], query) <= radius]


#: By number of flips: all masks of a piece with at most so many bits set.
_FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(1 << PIECE, dtype=np.uint16)) <= n) for n in range(PIECE + 1)]


def _classes(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): the class (of equal vectors) of every row, and one row (cls, rep, x) per class."""
    keyed = clean.withColumn("cls", F.struct(F.xxhash64("x").alias("a"), F.xxhash64("x", F.lit(1)).alias("b")))
    return keyed.select("vec_id", "cls"), keyed.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.first("x").alias("x"))


def search(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k rows found with the largest
    inner products, their own row left out."""
    spark = df.sparkSession
    clean = _clean(df, vec_id, embedding)
    sizes = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes["d"]
    members, classes = _classes(written(clean.where(F.size("x") == dim), "vectors"))
    classes = written(classes, "classes")
    count, norm2 = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))).first()
    part = min(1.0, SAMPLE / count)
    some = classes.where(F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(1 << 30)) < int(part * (1 << 30)) + (part == 1.0))
    sample = np.stack(some.select("x").toPandas()["x"].to_numpy())  # about SAMPLE rows at most
    model = spark.sparkContext.broadcast(learn(sample, float(np.sqrt(norm2)), k))
    asking = members.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = written(classes.join(asking.select("cls").distinct(), "cls", "left_semi"), "queries")
    blocks = -(-count // BLOCK)
    deal = lambda n: F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(n)).cast("int")

    def matrix(column) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)

    def best_in_blocks(asked: DataFrame, everything: bool) -> DataFrame:
        """(query, cls, rep, score): per query and block the k + 1 best classes in reach."""
        chunks = -(-asked.count() // BLOCK)
        every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        every_chunk = F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1)))
        left = asked.select("cls", "x", deal(max(chunks, 1)).alias("chunk"), every_block.alias("block")).groupBy("block", "chunk")
        right = classes.select("cls", "rep", "x", deal(blocks).alias("block"), every_chunk.alias("chunk")).groupBy("block", "chunk")

        def run(q: pa.Table, b: pa.Table) -> pa.Table:
            names = ["query", "cls", "rep", "score"]
            if not q.num_rows or not b.num_rows:
                return pa.table([q.column("cls").slice(0, 0), b.column("cls").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            m = model.value
            qx, bx, rep = matrix(q.column("x")), matrix(b.column("x")), b.column("rep").to_numpy()
            index = Index(m.codes(bx))
            asked_codes = m.codes(qx, query=True)
            who, which, scores = [], [], []
            for i in range(len(qx)):
                at = index.within(asked_codes[i], BITS if everything else m.radius)
                s = bx[at] @ qx[i]
                top = np.lexsort((rep[at], -s))[:k + 1]
                who.append(np.full(len(top), i))
                which.append(at[top])
                scores.append(s[top])
            who, which = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
            return pa.table([q.column("cls").take(who), b.column("cls").take(which), b.column("rep").take(which), pa.array(np.concatenate(scores))], names=names)

        kind = "struct<a:bigint,b:bigint>"
        return left.cogroup(right).applyInArrow(run, f"query {kind}, cls {kind}, rep bigint, score double")

    # members of a class, the smallest ids first: no result needs more than k + 1 of them
    shown = topk_per_group(members, ["cls"], [F.col("vec_id")], k + 1, salt_by=["vec_id"], rank_col="_m").drop("_m")
    sized = shown.groupBy("cls").agg(F.count(F.lit(1)).alias("m"))
    found = written(best_in_blocks(queries, False), "found")
    reach = found.join(sized, "cls").groupBy("query").agg(F.sum("m").alias("reach")).where(F.col("reach") > k)
    short = written(queries.join(reach.select(F.col("query").alias("cls")), "cls", "left_anti"), "queries")
    again = best_in_blocks(short, True) if not short.isEmpty() else found.limit(0)
    whole = found.join(short.select(F.col("cls").alias("query")), "query", "left_anti").select("query", "cls", "rep", "score").unionByName(again)

    best = topk_per_group(whole, ["query"], [F.desc("score"), F.col("rep")], k + 1, rank_col="_r").drop("_r", "rep")
    rows = asking.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query")).join(best, "query").join(shown, "cls").where(
        F.col("vec_id") != F.col("query_id"))
    ranked = topk_per_group(rows, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

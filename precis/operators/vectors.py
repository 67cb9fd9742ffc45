"""Vector operators: dot-product attention, causal masks, prototype pooling
(H40, H41, C8).

Attention is computed inside a row on ``array<array<double>>`` matrices with
higher-order functions (no Python).  Attention over tables (every vector to
all keys, for instance one prototype per label, averaged with a partial
aggregate) takes the keys in blocks and merges partial softmax states, so the
number of keys has no limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.operators.vocab import bounded_broadcast

__all__ = ["dot", "row_softmax", "causal_mask", "attention", "multi_head_attention",
           "label_prototypes", "key_blocks", "attend", "attention_pool", "MASK_VALUE"]

MASK_VALUE = -1e9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Sum of element-wise products of two numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def row_softmax(scores) -> Column:
    """H40 on one array: exp(x - max) / sum(exp(x - max))."""
    s = _c(scores)
    mx = F.array_max(s)
    ex = F.transform(s, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / tot)


def causal_mask(n) -> Column:
    """N x n boolean matrix, row i sees columns j <= i."""
    m = _c(n) if not isinstance(n, int) else F.lit(n)
    idx = F.sequence(F.lit(0), m - 1)
    return F.transform(idx, lambda i: F.transform(idx, lambda j: j <= i))


def attention(q, k, v, mask=None, causal: bool = False) -> Column:
    """softmax(q k^T / sqrt(d)) v for matrices held in one row.
    ``mask[i][j]`` false -> score MASK_VALUE; ``causal`` adds j <= i."""
    q, k, v = _c(q), _c(k), _c(v)
    d = F.size(F.element_at(q, 1)).cast("double")

    def row(qi, i):
        sc = F.transform(k, lambda kj, j: dot(qi, kj) / F.sqrt(d))
        if mask is not None:
            mrow = F.element_at(_c(mask), i + 1)
            sc = F.zip_with(sc, mrow, lambda s, m: F.when(m, s).otherwise(F.lit(MASK_VALUE)))
        if causal:
            sc = F.transform(sc, lambda s, j: F.when(j <= i, s).otherwise(F.lit(MASK_VALUE)))
        w = row_softmax(sc)
        dim = F.size(F.element_at(v, 1))
        return F.transform(F.sequence(F.lit(1), dim), lambda c: F.aggregate(
            F.zip_with(w, v, lambda wj, vj: wj * F.element_at(vj, c).cast("double")), F.lit(0.0),
            lambda acc, x: acc + x))
    return F.transform(q, row)


def _split_heads(m, h: int, n_heads: int, dh: int) -> Column:
    return F.transform(_c(m), lambda r: F.slice(r, h * dh + 1, dh))


def multi_head_attention(q, k, v, n_heads: int, dim: int, mask=None, causal: bool = False) -> Column:
    """H41 with heads: contiguous slices of width dim/n_heads, attended
    separately, concatenated back per position."""
    dh = dim // n_heads
    heads = [attention(_split_heads(q, h, n_heads, dh), _split_heads(k, h, n_heads, dh),
                       _split_heads(v, h, n_heads, dh), mask, causal) for h in range(n_heads)]
    merged = F.arrays_zip(*heads)
    return F.transform(merged, lambda s: F.concat(*[s[str(h)] for h in range(n_heads)]))


def label_prototypes(df: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """Mean vector per label (partial aggregate per dimension)."""
    aggs = [F.avg(F.element_at(F.col(vec), i + 1).cast("double")).alias(f"d{i}") for i in range(dim)]
    g = df.groupBy(label).agg(*aggs)
    return g.select(F.col(label).alias("label"), F.array(*[F.col(f"d{i}") for i in range(dim)]).alias("proto"))


#: Keys of one block, about.
BLOCK_KEYS = 1024


def key_blocks(keys: DataFrame, key: str, vec: str, block_keys: int = BLOCK_KEYS) -> tuple[DataFrame, int]:
    """(rows (_block, _keys array<struct<key, vec>>), number of blocks): keys dealt by hash to blocks of about ``block_keys``."""
    blocks = max(1, -(-keys.count() // block_keys))
    deal = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block")
    one = keys.select(deal, F.struct(F.col(key).alias("key"), F.col(vec).alias("vec")).alias("_k"))
    return one.groupBy("_block").agg(F.array_sort(F.collect_list("_k")).alias("_keys")), blocks  # about block_keys a row


def attend(queries: DataFrame, keys: DataFrame, key: str, vec: str, label: str, keyvec: str, dim: int,
           block_keys: int = BLOCK_KEYS) -> DataFrame:
    """H41 over tables: softmax(q k / sqrt(d)) k of every query over all keys: (key, best_label, best_weight, pooled).

    Online softmax: a query and a block of keys give a partial state (largest score, sum of exp(score - largest), the
    vectors weighted by it, the best label).  States merge by rescaling to the larger maximum, so any number of keys is
    a sum over blocks: no row, task or driver ever holds all of them.  ``key`` names queries uniquely; equal scores
    go to the smaller label."""
    packed, blocks = key_blocks(keys, label, keyvec, block_keys)
    packed = packed.checkpoint()
    x = queries.select(key, F.transform(F.col(vec), lambda e: e.cast("double")).alias("_q"))
    x = x.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = bounded_broadcast(packed)
    if side is packed:  # beyond a broadcast: each block meets the queries in several tasks
        salts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
        x = x.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        side = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        j = x.join(side, ["_block", "_salt"])
    else:
        j = x.join(side, "_block")
    j = j.select(key, "_keys", F.transform("_keys", lambda k: dot(F.col("_q"), k["vec"]) / F.lit(math.sqrt(dim))).alias("_s"))
    j = j.select(key, "_keys", "_s", F.array_max("_s").alias("_m"))
    j = j.select(key, "_keys", "_m", F.transform("_s", lambda s: F.exp(s - F.col("_m"))).alias("_e"),
                 F.element_at("_keys", F.array_position("_s", F.col("_m")).cast("int"))["key"].alias("_l"))
    part = [F.aggregate(F.zip_with("_e", "_keys", lambda e, k: e * F.element_at(k["vec"], c + 1)), F.lit(0.0), lambda a, t: a + t).alias(f"_a{c}")
            for c in range(dim)]
    j = j.select(key, "_m", "_l", F.aggregate("_e", F.lit(0.0), lambda a, t: a + t).alias("_z"), *part)
    top = F.max("_m").over(Window.partitionBy(key))  # one row per block of keys
    j = j.withColumn("_top", top).withColumn("_f", F.exp(F.col("_m") - F.col("_top")))
    g = j.groupBy(key).agg(F.sum(F.col("_z") * F.col("_f")).alias("_z"), F.min_by("_l", F.struct(-F.col("_m"), F.col("_l"))).alias("best_label"),
                           *[F.sum(F.col(f"_a{c}") * F.col("_f")).alias(f"_a{c}") for c in range(dim)])
    return g.select(key, "best_label", (1.0 / F.col("_z")).alias("best_weight"),
                    F.array(*[F.col(f"_a{c}") / F.col("_z") for c in range(dim)]).alias("pooled"))


def attention_pool(df: DataFrame, vec: str, label: str, dim: int, key: str = "vec_id", block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Each vector attends to the label prototypes, however many: (key, best_label, best_weight, pooled)."""
    protos = label_prototypes(df, vec, label, dim).where(F.col("label").isNotNull()).checkpoint()
    return attend(df, protos, key, vec, "label", "proto", dim, block_keys)

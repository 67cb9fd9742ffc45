"""Deterministic shuffles, exact positions and splits.

Exact positions without a single-partition window: rows are ordered by a
uniform 32-bit hash key (``md5(id:seed)``), cut into ``buckets`` hash ranges,
counted per range (a table of at most ``strata x buckets`` rows whose size is
known up front, hence broadcast), and numbered inside each range with a
partitioned window.  A hot stratum is therefore spread over many buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["shuffle_key", "seeded_shuffle", "global_position", "cut_key", "split_80_10_10",
           "stratified_split", "split_sizes", "union_splits", "assign_batches"]

_SPACE = 1 << 32


def shuffle_key(id_col="id", seed: int = 42) -> Column:
    """first 8 hex digits of md5('<id>:<seed>') as a bigint in [0, 2^32)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def seeded_shuffle(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """rows in seeded pseudo-random order (range-partitioned sort)."""
    return df.withColumn("_h", shuffle_key(id_col, seed)).orderBy("_h", id_col).drop("_h")


def global_position(df: DataFrame, hash_col: str, tie_col: str, strata: Sequence[str] = (),
                    buckets: int = 1024, out: str = "pos", total: str = "n") -> DataFrame:
    """0-based position of each row in (hash, tie) order within its stratum,
    plus the stratum size.  ``hash_col`` must be uniform in [0, 2^32)."""
    strata = list(strata)
    b = (F.col(hash_col) * F.lit(buckets) / F.lit(_SPACE)).cast("int").alias("_b")
    x = df.withColumn("_b", b)
    counts = x.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w_off = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*strata)
    offs = counts.select(*strata, "_b",
                         F.coalesce(F.sum("_c").over(w_off), F.lit(0)).alias("_off"),
                         F.sum("_c").over(w_all).alias(total))
    if not strata:
        offs = F.broadcast(offs)  # at most ``buckets`` rows
    rn = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy(hash_col, tie_col))
    x = x.withColumn("_rn", rn).join(offs, [*strata, "_b"])
    return x.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).drop("_b", "_rn", "_off")


def _three_way(pos: Column, n: Column, test_size: float, val_share: float) -> Column:
    n_temp = F.ceil(n.cast("double") * F.lit(test_size))
    n_test = F.ceil(n_temp.cast("double") * F.lit(val_share))
    return (F.when(pos < n_test, F.lit("test")).when(pos < n_temp, F.lit("validation"))
            .otherwise(F.lit("train")))


def cut_key(ids: DataFrame, position: int) -> tuple[int, object] | None:
    """(hash, id) of the row at ``position`` (from 0) in (``_h``, ``_id``) order, None behind the last row.

    Two counts by 16 bits of the hash find its value, the ids that share it settle ties: at most 65,536 rows reach
    the driver at a time, whatever the table's size, and only ids are read."""
    before, x, h = 0, ids, 0
    for shift in (16, 0):
        part = F.shiftright("_h", shift).bitwiseAND(F.lit(0xFFFF)).alias("b")
        counts = x.groupBy(part).agg(F.count(F.lit(1)).alias("c")).toArrow()
        rows = sorted(zip(counts.column("b").to_pylist(), counts.column("c").to_pylist(), strict=True))
        for b, c in rows:
            if before + c > position:
                break
            before += c
        else:
            return None
        h = (h << 16) | b
        x = x.where(F.shiftright("_h", shift) == h)
    ties = [r["_id"] for r in x.orderBy("_id").limit(position - before + 1).collect()]
    return h, ties[-1]


def split_80_10_10(df: DataFrame, id_col: str = "id", seed: int = 42, test_size: float = 0.2,
                   val_share: float = 0.5, buckets: int = 1024, positions: bool = False) -> DataFrame:
    """Exact sizes: temp = ceil(0.2 n), test = ceil(0.5 temp), val = rest of
    temp, train = the others; disjoint and complete (ids are unique).  Adds
    ``split``: two cut keys are found from the ids alone and every row is
    compared with them in place, so no row moves.  With ``positions`` also
    ``pos``, which takes a shuffle of the rows."""
    if not positions:
        ids = df.select(shuffle_key(id_col, seed).alias("_h"), F.col(id_col).alias("_id"))
        n = ids.count()
        n_temp = math.ceil(n * test_size)
        h, i = shuffle_key(id_col, seed), F.col(id_col)

        def below(position: int) -> Column:
            key = cut_key(ids, position)
            return F.lit(True) if key is None else (h < key[0]) | ((h == key[0]) & (i < F.lit(key[1])))
        return df.withColumn("split", F.when(below(math.ceil(n_temp * val_share)), F.lit("test"))
                             .when(below(n_temp), F.lit("validation")).otherwise(F.lit("train")))
    x = df.withColumn("_h", shuffle_key(id_col, seed))
    x = global_position(x, "_h", id_col, buckets=buckets)
    return x.withColumn("split", _three_way(F.col("pos"), F.col("n"), test_size, val_share)).drop("_h", "n")


def stratified_split(df: DataFrame, strata: Sequence[str], id_col: str = "id", seed: int = 42,
                     test_size: float = 0.2, val_share: float = 0.5, buckets: int = 64) -> DataFrame:
    """The same split applied inside every stratum."""
    x = df.withColumn("_h", shuffle_key(id_col, seed))
    x = global_position(x, "_h", id_col, strata=strata, buckets=buckets)
    return x.withColumn("split", _three_way(F.col("pos"), F.col("n"), test_size, val_share)).drop("_h", "n")


def split_sizes(df: DataFrame, col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def union_splits(*dfs: DataFrame) -> DataFrame:
    """G1: UNION ALL by column name, duplicates kept."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def assign_batches(df: DataFrame, size: int, id_col: str = "id", seed: int = 42,
                   drop_last: bool = True, strata: Sequence[str] = (), buckets: int = 1024) -> DataFrame:
    """Seeded shuffle, then consecutive fixed-size batches (``batch``,
    ``slot``); with ``drop_last`` the trailing partial batch is removed."""
    x = df.withColumn("_h", shuffle_key(id_col, seed))
    x = global_position(x, "_h", id_col, strata=strata, buckets=buckets)
    x = x.withColumn("batch", (F.col("pos") / F.lit(size)).cast("bigint")) \
         .withColumn("slot", (F.col("pos") % F.lit(size)).cast("int"))
    if drop_last:
        x = x.where(F.col("pos") < (F.col("n") / F.lit(size)).cast("bigint") * F.lit(size))
    return x.drop("_h", "n")

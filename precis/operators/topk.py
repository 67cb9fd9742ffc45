"""Top-k per group that survives a hot group (F1, F2, E5).

A plain ``row_number() OVER (PARTITION BY key ...)`` sends a whole group to
one task.  Here each group is first cut to k rows inside ``salt`` sub-groups
(the salt is a hash of a row-unique column), so the final window only sees
``k * salt`` candidates per group whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["topk_per_group", "rank_within"]


def rank_within(keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                   salt_by: Sequence[str] | None = None, salt: int = 16,
                   rank_col: str = "rank") -> DataFrame:
    """Rows with rank <= k inside each ``keys`` group; ``rank_col`` holds the rank.

    ``order`` must be a total order within a group (add a unique tie-breaker).
    ``salt_by``: row-unique columns used to spread a group before the cut.
    """
    if salt_by and salt > 1:
        s = (F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salt))).alias("_salt")
        pre = df.withColumn("_salt", s)
        pre = pre.withColumn("_r0", rank_within([*keys, "_salt"], order)).where(F.col("_r0") <= k)
        df = pre.drop("_salt", "_r0")
    return df.withColumn(rank_col, rank_within(keys, order)).where(F.col(rank_col) <= k)

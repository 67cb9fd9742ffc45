"""Length buckets and batch collation.

Bucket membership is a ``when`` chain; batch numbers inside a bucket come
from exact positions (``global_position``) in seeded order, so a bucket that
holds most rows is still numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.operators.split import global_position, shuffle_key

__all__ = ["BOUNDARIES", "BATCH_SIZES", "length_bucket", "bucket_by_length", "collate_longest"]

# Bucket boundaries and batch sizes of the packed-LM stream.
BOUNDARIES = [128, 256, 512, 1024]
BATCH_SIZES = [16, 8, 4, 2, 1]


def length_bucket(length, boundaries: Sequence[int] = BOUNDARIES, inclusive: bool = False) -> Column:
    """Bucket i holds length < boundaries[i] (<= with ``inclusive``); overflow last."""
    n = F.col(length) if isinstance(length, str) else length
    expr = None
    for i, b in enumerate(boundaries):
        cond = (n <= b) if inclusive else (n < b)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(boundaries)))


def bucket_by_length(df: DataFrame, length: str, id_col: str = "id",
                     boundaries: Sequence[int] = BOUNDARIES, batch_sizes: Sequence[int] = BATCH_SIZES,
                     seed: int = 42, inclusive: bool = False, buckets: int = 256) -> DataFrame:
    """(bucket, batch, slot) per row; incomplete batches are not emitted."""
    size_of = F.element_at(F.array(*[F.lit(s) for s in batch_sizes]), F.col("bucket") + 1)
    x = df.withColumn("bucket", length_bucket(length, boundaries, inclusive)) \
          .withColumn("_h", shuffle_key(id_col, seed))
    x = global_position(x, "_h", id_col, strata=["bucket"], buckets=buckets)
    x = x.withColumn("_bs", size_of)
    x = x.where(F.col("pos") < (F.col("n") / F.col("_bs")).cast("bigint") * F.col("_bs"))
    return (x.withColumn("batch", (F.col("pos") / F.col("_bs")).cast("bigint"))
             .withColumn("slot", (F.col("pos") % F.col("_bs")).cast("int"))
             .drop("_h", "_bs", "n"))


def collate_longest(df: DataFrame, ids: str, batch_keys: Sequence[str], pad: int = 0,
                    out: str | None = None) -> DataFrame:
    """Pad every sequence to the longest one of its batch."""
    longest = F.max(F.size(F.col(ids))).over(Window.partitionBy(*batch_keys))
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(pad), longest - F.size(F.col(ids))))
    return df.withColumn(out or ids, padded)

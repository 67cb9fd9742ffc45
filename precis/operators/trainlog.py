"""Training logs: epoch losses (D6) and early stopping.

``learning_curve`` derives an epoch log from data: epoch e is the add-k
bigram model fitted on the first e hash shards of the training rows (counts
are expanded to every later epoch and summed once, so all epochs come out of
one plan).  Losses are means of per-batch means, as the reference averages
batch losses per epoch.

``early_stopping`` works on any (run, epoch, val_loss) table with windows
partitioned by run (one row per epoch: bounded).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.operators.lm import ngram_pairs

__all__ = ["epoch_mean_loss", "learning_curve", "early_stopping", "early_stopping_summary"]


def epoch_mean_loss(losses: DataFrame, loss: str = "loss", epoch: str = "epoch", batch: str = "batch") -> DataFrame:
    """Per epoch, the mean over batches of the batch mean loss."""
    b = losses.groupBy(epoch, batch).agg(F.avg(loss).alias("_b"))
    return b.groupBy(epoch).agg(F.avg("_b").alias("mean_loss"), F.count(F.lit(1)).alias("batches"))


def learning_curve(train: DataFrame, val: DataFrame, vocab_size: int, epochs: int, k: float = 1.0,
                   seq: str = "seq") -> DataFrame:
    """(epoch, train_loss, val_loss).  ``train`` has (seq, shard 1..epochs,
    batch); ``val`` has (seq, batch)."""
    tp = ngram_pairs(train, seq, 2, keep=["shard", "batch"])
    c = tp.groupBy("shard", "ctx", "token").agg(F.count(F.lit(1)).alias("c"))
    ce = (c.select(F.explode(F.sequence("shard", F.lit(epochs))).alias("epoch"), "ctx", "token", "c")
          .groupBy("epoch", "ctx", "token").agg(F.sum("c").alias("c")))
    te = ce.groupBy("epoch", "ctx").agg(F.sum("c").alias("tot"))

    def losses(p: DataFrame) -> DataFrame:
        j = p.join(ce, ["epoch", "ctx", "token"], "left").join(te, ["epoch", "ctx"], "left")
        lp = F.log((F.coalesce("c", F.lit(0)) + F.lit(k)) / (F.coalesce("tot", F.lit(0)) + F.lit(k * vocab_size)))
        return j.select("epoch", "batch", (-lp).alias("loss"))

    tr = epoch_mean_loss(losses(tp.withColumnRenamed("shard", "epoch"))).select(
        "epoch", F.col("mean_loss").alias("train_loss"))
    vp = ngram_pairs(val, seq, 2, keep=["batch"])
    va = epoch_mean_loss(losses(vp.select(F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"),
                                          "batch", "ctx", "token"))).select("epoch", F.col("mean_loss").alias("val_loss"))
    return tr.join(va, "epoch")


def early_stopping(log: DataFrame, value: str = "val_loss", patience: int = 3, by: Sequence[str] = ("run",),
                   epoch: str = "epoch") -> DataFrame:
    """Per epoch — improved (strictly below every earlier value), best so
    far, epochs without improvement, and stop (first epoch reaching patience)."""
    w_prev = Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_upto = Window.partitionBy(*by).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    prev_best = F.min(value).over(w_prev)
    x = log.withColumn("improved", prev_best.isNull() | (F.col(value) < prev_best))
    x = x.withColumn("best_so_far", F.min(value).over(w_upto))
    last_imp = F.max(F.when(F.col("improved"), F.col(epoch))).over(w_upto)
    x = x.withColumn("since_best", (F.col(epoch) - last_imp).cast("int"))
    reached = F.col("since_best") >= patience
    first_reach = F.min(F.when(reached, F.col(epoch))).over(Window.partitionBy(*by))
    return x.withColumn("stop", F.coalesce(F.col(epoch) == first_reach, F.lit(False)))


def early_stopping_summary(flags: DataFrame, by: Sequence[str] = ("run",), epoch: str = "epoch",
                           value: str = "val_loss") -> DataFrame:
    """Best epoch (last improvement at or before the stop) and stop epoch (null = never)."""
    stop = flags.groupBy(*by).agg(F.min(F.when(F.col("stop"), F.col(epoch))).alias("stop_epoch"))
    j = flags.join(stop, list(by))
    upto = j.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    best = upto.groupBy(*by).agg(F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
                                 F.min(value).alias("best_value"))
    return best.join(stop, list(by))



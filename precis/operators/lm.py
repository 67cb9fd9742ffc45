"""Table-backed n-gram language model and its losses.

The reference trains neural next-token models; here the same role is played
by a model Spark can fit exactly: add-k smoothed n-gram counts.  Fitting is
one explode + hash aggregate on (context, token) — partial aggregation makes
frequent contexts cheap — and every per-context table is bounded by the
vocabulary, so look-ups broadcast after a size check.

Context keys are the previous ``order-1`` ids joined by a space.

``fit_backoff_lm`` is the model that decoding uses: order 3, backing off to
shorter contexts, so that every token of the vocabulary has a probability after
every context and the best k of them are found exactly (``BackoffLM.ranked``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.operators.topk import topk_per_group
from precis.operators.vocab import PAD, bounded_broadcast

__all__ = ["ngram_pairs", "fit_ngram_lm", "context_table", "score_pairs", "cross_entropy",
           "token_accuracy", "masked_mean_loss", "log_softmax", "softmax", "argmax_table",
           "topk_table", "context_key", "BackoffLM", "fit_backoff_lm", "pair_key"]


def context_key(seq, end, order: int) -> Column:
    """Key of the ``order-1`` ids ending at 1-based position ``end``."""
    s = F.col(seq) if isinstance(seq, str) else seq
    e = F.lit(end) if isinstance(end, int) else end
    return F.array_join(F.transform(F.slice(s, e - (order - 2), order - 1), lambda x: x.cast("string")), " ")


def ngram_pairs(df: DataFrame, seq: str, order: int = 2, keep: Sequence[str] = (),
                mask: str | None = None) -> DataFrame:
    """Every (context, next token) of each sequence, with the target position
    ``t`` (1-based) and, if given, the mask value at the target."""
    s = F.col(seq)
    n = F.size(s) - (order - 1)
    items = F.transform(F.sequence(F.lit(order), F.size(s)), lambda t: F.struct(
        t.alias("t"), context_key(s, t - 1, order).alias("ctx"), F.element_at(s, t).alias("token"),
        *([F.element_at(F.col(mask), t).alias("m")] if mask else [])))
    items = F.when(n > 0, items)
    ex = df.select(*keep, F.explode(items).alias("p"))
    return ex.select(*keep, "p.*")


def fit_ngram_lm(df: DataFrame, seq: str, vocab_size: int, order: int = 2, k: float = 1.0) -> DataFrame:
    """(ctx, token, count, logp) for every seen pair; add-k smoothing
    logp = ln((c + k) / (c_ctx + k V))."""
    counts = ngram_pairs(df, seq, order).groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy("ctx"))
    return counts.select("ctx", "token", "count",
                         F.log((F.col("count") + F.lit(k)) / (tot + F.lit(k * vocab_size))).alias("logp"))


def context_table(lm: DataFrame, vocab_size: int, k: float = 1.0) -> DataFrame:
    """Per context: total count, seen successors, log-prob of an unseen
    successor and the mean of -logp over the whole vocabulary (for D9)."""
    g = lm.groupBy("ctx").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_seen"),
                              F.sum("logp").alias("sum_logp"))
    unseen = F.log(F.lit(k) / (F.col("total") + F.lit(k * vocab_size)))
    mean_nll = -(F.col("sum_logp") + (F.lit(vocab_size) - F.col("n_seen")) * unseen) / F.lit(vocab_size)
    return g.select("ctx", "total", "n_seen", unseen.alias("unseen_logp"), mean_nll.alias("mean_nll"))


def score_pairs(pairs: DataFrame, lm: DataFrame, ctx_tab: DataFrame, vocab_size: int) -> DataFrame:
    """Adds ``logp`` (seen pair, else the context's unseen value, else the
    uniform -ln V) and ``mean_nll`` (uniform context: ln V) to pairs."""
    import math
    j = (pairs.join(bounded_broadcast(lm.select("ctx", "token", F.col("logp").alias("_lp"))), ["ctx", "token"], "left")
         .join(bounded_broadcast(ctx_tab.select("ctx", "unseen_logp", "mean_nll")), "ctx", "left"))
    uni = F.lit(-math.log(vocab_size))
    return j.withColumn("logp", F.coalesce("_lp", "unseen_logp", uni)) \
            .withColumn("mean_nll", F.coalesce("mean_nll", -uni)).drop("_lp", "unseen_logp")


def cross_entropy(scored: DataFrame, group_by: Sequence[str] = (), eps: float = 0.1,
                  pad: int = PAD) -> DataFrame:
    """Mean -logp over non-PAD targets, perplexity, and the label-smoothed
    loss (1-eps)*nll + eps*mean_v(-logp)."""
    x = scored.where(F.col("token") != pad)
    aggs = [F.count(F.lit(1)).alias("tokens"), F.avg(-F.col("logp")).alias("ce"),
            F.avg((1 - eps) * -F.col("logp") + eps * F.col("mean_nll")).alias("ce_smooth")]
    g = x.groupBy(*group_by).agg(*aggs) if group_by else x.agg(*aggs)
    return g.withColumn("ppl", F.exp("ce"))


def argmax_table(lm: DataFrame) -> DataFrame:
    """greedy successor per context (highest count, then lowest id)."""
    return lm.groupBy("ctx").agg(F.max_by("token", F.struct(F.col("count"), -F.col("token"))).alias("next"))


def topk_table(lm: DataFrame, k: int) -> DataFrame:
    """the k most likely successors per context with their rank (0-based);
    a context has at most V rows, so the window is bounded."""
    w = Window.partitionBy("ctx").orderBy(F.desc("logp"), F.asc("token"))
    return lm.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k) \
             .select("ctx", "token", "logp", "rank")


def token_accuracy(pairs: DataFrame, lm: DataFrame, group_by: Sequence[str] = (), pad: int = PAD,
                   mask_col: str | None = None) -> DataFrame:
    """Share of (unmasked, non-PAD) targets equal to the context's argmax."""
    am = bounded_broadcast(argmax_table(lm))
    x = pairs.where(F.col("token") != pad)
    if mask_col:
        x = x.where(F.col(mask_col) == 1)
    j = x.join(am, "ctx", "left")
    hit = F.when(F.col("next") == F.col("token"), 1.0).otherwise(0.0)
    aggs = [F.avg(hit).alias("accuracy")]
    return j.groupBy(*group_by).agg(*aggs) if group_by else j.agg(*aggs)


def masked_mean_loss(scored: DataFrame, mask_col: str = "m", group_by: Sequence[str] = ()) -> DataFrame:
    """sum(loss * mask) / (sum(mask) + 1e-9)."""
    loss = -F.col("logp") * F.col(mask_col)
    aggs = [(F.sum(loss) / (F.sum(F.col(mask_col)) + F.lit(1e-9))).alias("masked_loss")]
    return scored.groupBy(*group_by).agg(*aggs) if group_by else scored.agg(*aggs)


def log_softmax(df: DataFrame, group: Sequence[str], score: str, out: str = "logp") -> DataFrame:
    """X - logsumexp(x) per group, stable (max subtracted first).
    Groups are contexts / query rows, bounded by the vocabulary or key count."""
    w = Window.partitionBy(*group)
    mx = F.max(score).over(w)
    lse = mx + F.log(F.sum(F.exp(F.col(score) - mx)).over(w))
    return df.withColumn(out, F.col(score) - lse)


def softmax(df: DataFrame, group: Sequence[str], score: str, out: str = "p") -> DataFrame:
    return log_softmax(df, group, score, "_ls").withColumn(out, F.exp("_ls")).drop("_ls")


# ---------------------------------------------------------------- back-off model
#: Absolute discount of every seen count, and digits that log-probabilities are kept to (sums of them are then the
#: same wherever they are added up in the same order).
DISCOUNT, DIGITS = 0.75, 9


def pair_key(before, last) -> Column:
    """Two ids as one number: the context of an order-3 model."""
    return F.shiftleft(before.cast("bigint"), 32).bitwiseOR(last.cast("bigint"))


class BackoffLM:
    """An order-3 model over the whole vocabulary, as tables.

    ``unigrams`` (token, p, logp): every token of the vocabulary.
    ``seen[n]`` (ctx, token, count, p, logp) for n = 2, 3: seen successors of a context (the last id, or the
    key of the last two).  ``bows[n]`` (ctx, bow): log of the weight that the lower order has after the context.
    A successor that was not seen has the log-probability bow + that of the lower order; after a context that
    was not seen, that of the lower order."""

    def __init__(self, unigrams: DataFrame, seen: dict[int, DataFrame], bows: dict[int, DataFrame]):
        self.unigrams, self.seen, self.bows = unigrams, seen, bows

    def ranked(self, k: int) -> tuple[list, dict[int, DataFrame]]:
        """F2 over the whole vocabulary: the k best successors (logp, then lowest token) without a context, and per seen
        context of each order (ctx, cand array<struct<token, logp>>).

        A token that was not seen after a context and is not among the k best of the lower order has k tokens before it
        there; they come before it here as well, because seen ones only gain.  So seen successors and the lower order's
        k best are all the candidates there are, and no context meets the vocabulary."""
        best = [(r["token"], r["logp"]) for r in self.unigrams.orderBy(F.desc("logp"), "token").limit(k).collect()]
        lower = F.array(*[F.struct(F.lit(t).cast("int").alias("token"), F.lit(lp).alias("logp")) for t, lp in best])
        out: dict[int, DataFrame] = {}
        for n in sorted(self.seen):
            ctx = self.bows[n]
            if n == 2:
                ctx = ctx.withColumn("cand", lower)
            else:  # the lower order's context is the last id; it was seen, as the longer context was
                last = F.col("ctx").bitwiseAND(F.lit(0xFFFFFFFF))
                ctx = ctx.withColumn("_low", last).join(bounded_broadcast(out[n - 1].withColumnRenamed("ctx", "_low")), "_low").drop("_low")
            backed = ctx.select("ctx", "bow", F.explode("cand").alias("c")).select(
                "ctx", F.col("c.token").alias("token"), (F.col("bow") + F.col("c.logp")).alias("backed"), F.lit(None).cast("double").alias("own"))
            own = self.seen[n].select("ctx", "token", F.lit(None).cast("double").alias("backed"), F.col("logp").alias("own"))
            one = own.unionByName(backed).groupBy("ctx", "token").agg(F.coalesce(F.max("own"), F.max("backed")).alias("logp"))
            top = topk_per_group(one, ["ctx"], [F.desc("logp"), F.asc("token")], k, salt_by=["token"])
            pick = F.array_sort(F.collect_list(F.struct("rank", "token", "logp")))  # k a context
            out[n] = top.groupBy("ctx").agg(F.transform(pick, lambda s: F.struct(s["token"].alias("token"), s["logp"].alias("logp"))).alias("cand")).checkpoint()
        return best, out


def fit_backoff_lm(df: DataFrame, seq: str, vocab: DataFrame, order: int = 3, discount: float = DISCOUNT,
                   k: float = 1.0) -> BackoffLM:
    """Absolute discounting, interpolated with the next lower order down to add-k unigrams over ``vocab``
    (token_id).  Every order comes from one count of (last two ids, next id)."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    s = F.col(seq)
    items = F.transform(F.sequence(F.lit(2), F.size(s)), lambda t: F.struct(
        F.when(t > 2, F.element_at(s, F.greatest(t - 2, F.lit(1)))).alias("u"), F.element_at(s, t - 1).alias("v"), F.element_at(s, t).alias("token")))
    grams = df.where(F.size(s) >= 2).select(F.explode(items).alias("g")).select("g.*")
    c3 = grams.groupBy("u", "v", "token").agg(F.count(F.lit(1)).alias("count")).checkpoint()
    c2 = c3.groupBy(F.col("v").cast("bigint").alias("ctx"), "token").agg(F.sum("count").alias("count")).checkpoint()
    c1 = c2.groupBy("token").agg(F.sum("count").alias("count"))
    V, N = vocab.count(), c2.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    logp = F.round(F.log("p"), DIGITS).alias("logp")
    uni = vocab.select(F.col("token_id").cast("int").alias("token")).join(c1, "token", "left").select(
        "token", ((F.coalesce("count", F.lit(0)) + F.lit(k)) / F.lit(N + k * V)).alias("p"))
    uni = uni.select("token", "p", logp).checkpoint()

    def level(counts: DataFrame, low: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
        """Seen successors and back-off weights of one order over ``low`` (p of the lower order by ``on``)."""
        ctx = counts.groupBy("ctx").agg(F.sum("count").alias("total"), (F.lit(discount) * F.count(F.lit(1)) / F.sum("count")).alias("weight")).checkpoint()
        j = counts.join(bounded_broadcast(low.withColumnRenamed("p", "_low")), on).join(bounded_broadcast(ctx), "ctx")
        p = (F.col("count") - F.lit(discount)) / F.col("total") + F.col("weight") * F.col("_low")
        seen = j.select("ctx", "token", "count", p.alias("p")).select("ctx", "token", "count", "p", logp).checkpoint()
        return seen, ctx.select("ctx", F.round(F.log("weight"), DIGITS).alias("bow"))

    seen2, bow2 = level(c2, uni.select("token", "p"), ["token"])
    seen, bows = {2: seen2}, {2: bow2}
    if order == 3:
        c = c3.where(F.col("u").isNotNull()).select(pair_key(F.col("u"), F.col("v")).alias("ctx"), F.col("v").cast("bigint").alias("_v"), "token", "count")
        seen[3], bows[3] = level(c, seen2.select(F.col("ctx").alias("_v"), "token", "p"), ["_v", "token"])
    return BackoffLM(uni, seen, bows)

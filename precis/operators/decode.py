"""Decoding over all documents at once.

Each step is a join of the rows with per-context tables of their best
successors (a few per context) that are broadcast after a size check — so a
step moves no document data; beyond that size the join shuffles, and rows that
have ended carry keys of their own, so they neither match nor meet.  With a
back-off model every context has successors, ranked over the whole vocabulary;
with a plain n-gram table a context without seen successors ends a row.  The
state is written with ``checkpoint()`` every few steps (into the cluster's
checkpoint folder) to cut lineage; a lost executor recomputes at most those
steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.operators.lm import BackoffLM, context_key, pair_key, topk_table
from precis.operators.vocab import EOS, bounded_broadcast

__all__ = ["Successors", "greedy_decode", "beam_search", "beam_expand", "beam_prune", "length_penalty"]


class Successors:
    """the k best successors of each context as arrays, from a back-off model or from a plain n-gram table."""

    def __init__(self, lm: BackoffLM | DataFrame, k: int, order: int = 2):
        self.order, self.backoff = order, isinstance(lm, BackoffLM)
        if self.backoff:
            best, tables = lm.ranked(k)
            self.any = F.array(*[F.struct(F.lit(t).cast("int").alias("token"), F.lit(lp).alias("logp")) for t, lp in best])
            self.tables = [(n, bounded_broadcast(tables[n].select(F.col("ctx").alias(f"_c{n}"), F.col("cand").alias(f"_n{n}")))) for n in sorted(tables, reverse=True)]
        else:
            rows = topk_table(lm, k).groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "logp"))).alias("_r"))  # k a context
            cand = F.transform("_r", lambda s: F.struct(s["token"].alias("token"), s["logp"].alias("logp")))
            self.any = None
            self.tables = [(order, bounded_broadcast(rows.select(F.col("ctx").alias(f"_c{order}"), cand.alias(f"_n{order}"))))]

    def attach(self, df: DataFrame, key: str, seq: str, live) -> DataFrame:
        """``df`` with ``cand``, the best successors of ``seq`` in order; null for rows that are not ``live``."""
        s, own = F.col(seq), -F.abs(F.xxhash64(key)) - 1  # no context has a negative key
        found = []
        for n, table in self.tables:
            if self.backoff:
                ctx = F.element_at(s, -1).cast("bigint") if n == 2 else F.when(F.size(s) >= 2, pair_key(F.element_at(s, -2), F.element_at(s, -1)))
            else:
                ctx, own = context_key(s, F.size(s), n), F.concat(F.lit("-"), F.col(key).cast("string"))
            df = df.withColumn(f"_c{n}", F.coalesce(F.when(live, ctx), own)).join(table, f"_c{n}", "left").drop(f"_c{n}")
            found.append(F.col(f"_n{n}"))
        cand = F.when(live, F.coalesce(*found, *([self.any] if self.any is not None else [])))
        return df.withColumn("cand", cand).drop(*[f"_n{n}" for n, _ in self.tables])


def greedy_decode(starts: DataFrame, lm: BackoffLM | DataFrame, order: int = 2, max_len: int = 50, eos: int = EOS,
                  key: str = "id", seq: str = "prompt", checkpoint_every: int = 10) -> DataFrame:
    """Append the best successor until EOS, a context without
    successors, or ``max_len`` generated tokens.  Returns (key, generated)."""
    best = Successors(lm, 1, order)
    st = starts.select(key, F.col(seq).alias("seq"), F.lit(True).alias("live"),
                       F.array().cast("array<int>").alias("generated"))
    for step in range(max_len):
        j = best.attach(st, key, "seq", F.col("live")).withColumn("next", F.element_at("cand", 1)["token"])
        go = F.col("live") & F.col("next").isNotNull() & (F.col("next") != eos)
        st = j.select(key,
                      F.when(go, F.concat("seq", F.array("next"))).otherwise(F.col("seq")).alias("seq"),
                      F.coalesce(go, F.lit(False)).alias("live"),
                      F.when(go, F.concat("generated", F.array("next"))).otherwise(F.col("generated")).alias("generated"))
        if checkpoint_every and (step + 1) % checkpoint_every == 0 and step + 1 < max_len:
            st = st.checkpoint()
            if st.where("live").isEmpty():
                break
    return st.select(key, "generated")


def length_penalty(score, length, p: float) -> F.Column:
    """Score / length^p (p = 0: no normalisation)."""
    return score / F.pow(length.cast("double"), F.lit(p)) if p else score


def beam_expand(beams: DataFrame, best: Successors, k: int, eos: int, key: str, min_len: int = 0) -> DataFrame:
    """Every live beam x its ``k`` best successors; finished beams (and
    beams whose context has no successor) carry over as their own candidate.
    One left join per table, read once — the plan stays linear in the step count.

    ``best`` holds k + 1 successors, so a beam shorter than ``min_len`` has k of
    them without EOS: EOS takes no place and no beam disappears."""
    j = best.attach(beams, key, "seq", ~F.col("done"))
    short = F.col("glen") < min_len
    cand = F.slice(F.when(short, F.filter("cand", lambda c: c["token"] != eos)).otherwise(F.col("cand")), 1, k) if min_len else F.slice("cand", 1, k)
    j = j.select(key, "beam", "score", "seq", "done", "glen", F.posexplode_outer(cand).alias("rank", "c"))
    m = F.col("c").isNotNull()
    return j.select(
        key, F.col("beam").alias("parent"),
        F.when(m, F.col("rank")).otherwise(F.lit(-1)).alias("rank"),
        F.when(m, F.col("score") + F.col("c.logp")).otherwise(F.col("score")).alias("score"),
        F.when(m, F.concat("seq", F.array("c.token"))).otherwise(F.col("seq")).alias("seq"),
        # without a successor a beam has ended, unless only the bar on EOS keeps it: then it stays, unfinished
        F.when(m, F.col("c.token") == eos).otherwise(F.col("done") | (F.col("glen") >= min_len)).alias("done"),
        (F.col("glen") + F.when(m, 1).otherwise(0)).alias("glen"))


def beam_prune(cands: DataFrame, beam_size: int, key: str) -> DataFrame:
    """E5: the best ``beam_size`` candidates per document, stable order
    (score desc, parent beam, successor rank).  A document has at most
    beam_size^2 + beam_size candidates, so the window is bounded."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("parent"), F.asc("rank"))
    r = cands.withColumn("beam", F.row_number().over(w) - 1).where(F.col("beam") < beam_size)
    return r.select(key, "beam", "score", "seq", "done", "glen")


def beam_search(starts: DataFrame, lm: BackoffLM | DataFrame, beam_size: int = 3, max_len: int = 50, order: int = 2,
                eos: int = EOS, key: str = "id", seq: str = "prompt", length_p: float = 0.0,
                min_len: int = 0, checkpoint_every: int = 5) -> DataFrame:
    """Beam search for every document together.  No length
    normalisation by default (``length_p`` > 0 ranks finals by score/len^p);
    stops when every beam of every document has ended or after max_len
    steps; the best beam is returned even if unfinished.
    Returns (key, generated, score, finished)."""
    best = Successors(lm, beam_size + 1, order)
    beams = starts.select(key, F.lit(0).alias("beam"), F.lit(0.0).alias("score"),
                          F.col(seq).alias("seq"), F.lit(False).alias("done"), F.lit(0).alias("glen"),
                          F.size(F.col(seq)).alias("plen"))
    plen = beams.select(key, "plen")
    beams = beams.drop("plen")
    for step in range(max_len):
        beams = beam_prune(beam_expand(beams, best, beam_size, eos, key, min_len), beam_size, key)
        if checkpoint_every and (step + 1) % checkpoint_every == 0 and step + 1 < max_len:
            beams = beams.checkpoint()
            if beams.where(~F.col("done")).isEmpty():
                break
    final = beams.join(plen, key)
    rank_score = length_penalty(F.col("score"), F.greatest(F.col("glen"), F.lit(1)), length_p)
    w = Window.partitionBy(key).orderBy(F.desc("_rs"), F.asc("beam"))
    top = final.withColumn("_rs", rank_score).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    gen = F.slice(F.col("seq"), F.col("plen") + 1, F.greatest(F.size("seq") - F.col("plen"), F.lit(0)))
    return top.select(key, gen.alias("generated"), F.col("score"), F.col("done").alias("finished"))

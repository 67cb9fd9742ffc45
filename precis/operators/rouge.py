"""ROUGE-N / ROUGE-L / ROUGE-Lsum (Lin 2004), BLEU (Papineni et al. 2002).

Per-row scores are computed inside each row — no shuffle:

* n-gram overlap with clipping: both n-gram arrays are tagged, merged with one
  ``array_sort`` and folded with ``aggregate`` counting runs of equal grams —
  O((n+m) log(n+m)) per row, JVM-side.
* ``rouge_columns`` (several kinds of whole tables) counts the n-gram overlaps
  and the LCS of a batch of rows in one Arrow pass: grams are numbers, and the
  counts of all rows are sorted together.
* LCS: an Arrow-batched pandas UDF with the bit-parallel LCS recurrence
  (Allison-Dix / Hyyro), O(n * m / 64) per row, so whole documents are fine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.functions.arrays import ngrams
from precis.functions.porter import stem as _stem

__all__ = ["rouge_tokens", "clipped_overlap", "prf", "rouge_n", "rouge_l", "rouge_lsum",
           "lcs_length", "stem_tokens", "bleu", "rouge_columns"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    """Porter-stem tokens longer than three characters."""
    return pd.Series([[(_stem(t) if len(t) > 3 else t) for t in arr] if arr is not None else []
                      for arr in tokens])


def rouge_tokens(text, stem: bool = False, unicode: bool = False) -> Column:
    """Scorer tokenization: lower-case, runs of [a-z0-9] (``unicode=True``:
    letters and digits of any script), optional Porter stemming."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    pat = r"[^\p{L}\p{N}]+" if unicode else r"[^a-z0-9]+"
    toks = F.filter(F.split(F.regexp_replace(t, F.lit(pat), F.lit(" ")), " "), lambda x: x != F.lit(""))
    return stem_tokens(toks) if stem else toks


def clipped_overlap(a, b) -> Column:
    """sum over distinct grams g of min(count_a(g), count_b(g))."""
    tagged = F.array_sort(F.concat(
        F.transform(_c(a), lambda x: F.struct(x.alias("g"), F.lit(0).alias("s"))),
        F.transform(_c(b), lambda x: F.struct(x.alias("g"), F.lit(1).alias("s")))))
    zero = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("a"),
                    F.lit(0).alias("b"), F.lit(0).alias("o"))

    def step(acc, e):
        same = F.struct(e["g"].alias("p"), (acc["a"] + 1 - e["s"]).alias("a"),
                        (acc["b"] + e["s"]).alias("b"), acc["o"].alias("o"))
        new = F.struct(e["g"].alias("p"), (1 - e["s"]).alias("a"), e["s"].alias("b"),
                       (acc["o"] + F.least(acc["a"], acc["b"])).alias("o"))
        return F.when(acc["p"].eqNullSafe(e["g"]), same).otherwise(new)

    return F.aggregate(tagged, zero, step, lambda acc: acc["o"] + F.least(acc["a"], acc["b"]))


def prf(hits, n_cand, n_ref) -> Column:
    """(precision, recall, fmeasure) with the scorer's zero guards."""
    p = _c(hits) / F.greatest(_c(n_cand), F.lit(1))
    r = _c(hits) / F.greatest(_c(n_ref), F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                    f.cast("double").alias("fmeasure"))


def rouge_n(cand_tokens, ref_tokens, n: int = 1) -> Column:
    """I16: clipped n-gram overlap P/R/F of one row."""
    cg, rg = ngrams(cand_tokens, n), ngrams(ref_tokens, n)
    return prf(clipped_overlap(cg, rg), F.size(cg), F.size(rg))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    if not len(a) or not len(b):
        return 0
    if len(b) > len(a):
        a, b = b, a
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int32")


def rouge_l(cand_tokens, ref_tokens) -> Column:
    """LCS-based P/R/F of one row."""
    return prf(_lcs_udf(_c(cand_tokens), _c(ref_tokens)), F.size(_c(cand_tokens)), F.size(_c(ref_tokens)))


def _lcs_positions(r: list, c: list) -> set:
    """Indices into ``r`` of one LCS of r and c: from the ends, a match is taken, else the token of ``r`` is left if the
    LCS is as long without it, else that of ``c``.

    One bit mask per token of ``r`` holds a row of the dynamic program (bit j is 0 where the LCS grows with token j of
    ``c``), so memory is len(r) x len(c) bits, and every step of the trace reads one mask."""
    masks: dict = {}
    for j, t in enumerate(c):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(c)) - 1
    rows = [full]
    for t in r:
        v = rows[-1]
        u = v & masks.get(t, 0)
        rows.append(((v + u) | (v - u)) & full)
    i, j = len(r), len(c)
    here, above = (j - (rows[k] & ((1 << j) - 1)).bit_count() if k >= 0 else 0 for k in (i, i - 1))  # LCS of (i, j) and (i - 1, j)
    out = set()
    while i > 0 and j > 0:
        if r[i - 1] == c[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif here == above:
            i -= 1
        else:
            j -= 1
            here -= 1 - (rows[i] >> j & 1)
            above -= 1 - (rows[i - 1] >> j & 1)
            continue
        low = (1 << j) - 1
        here = j - (rows[i] & low).bit_count()
        above = j - (rows[i - 1] & low).bit_count() if i else 0
    return out


def _lsum_hits(ref_sents: list, cand_sents: list) -> tuple[int, int, int]:
    from collections import Counter
    ref_all = [t for s in ref_sents for t in s]
    cand_all = [t for s in cand_sents for t in s]
    if not ref_all or not cand_all:
        return 0, len(cand_all), len(ref_all)
    cr, cc = Counter(ref_all), Counter(cand_all)
    hits = 0
    for r in ref_sents:
        union = set()
        for c in cand_sents:
            union |= _lcs_positions(r, c)
        for idx in sorted(union):
            t = r[idx]
            if cr[t] > 0 and cc[t] > 0:
                hits += 1
                cr[t] -= 1
                cc[t] -= 1
    return hits, len(cand_all), len(ref_all)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("hits", "n_cand", "n_ref")]))
def _lsum_udf(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = []
    for c, r in zip(cand, ref):
        cs = [list(s) for s in c] if c is not None else []
        rs = [list(s) for s in r] if r is not None else []
        rows.append(_lsum_hits(rs, cs))
    return pd.DataFrame(rows, columns=["hits", "n_cand", "n_ref"]).astype("int32")


def rouge_lsum(cand_text, ref_text, stem: bool = False) -> Column:
    """Summary-level union-LCS over newline-separated sentences."""
    def sents(x):
        lines = F.split(F.coalesce(_c(x), F.lit("")), "\n")
        return F.filter(F.transform(lines, lambda s: rouge_tokens(s, stem)), lambda s: F.size(s) > 0)
    h = _lsum_udf(sents(cand_text), sents(ref_text))
    return prf(h["hits"], h["n_cand"], h["n_ref"])


def _coded(a: pa.Array, b: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Token numbers of two list columns (one numbering for both), and the row of every token; a null list is empty."""
    flat = [pc.list_flatten(x) for x in (a, b)]
    codes = pc.fill_null(pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices, 0).to_numpy().astype(np.int64)
    rows = [np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for x in (a, b)]
    return [codes[:len(flat[0])], codes[len(flat[0]):]], rows


def _overlap(codes: list[np.ndarray], rows: list[np.ndarray], n: int, count: int) -> np.ndarray:
    """Per row: the sum over n-grams of the lesser of their counts on the two sides."""
    grams, at = [], []
    for c, r in zip(codes, rows):
        whole = r[:len(r) - n + 1] == r[n - 1:] if len(r) >= n else np.zeros(0, bool)
        at.append(r[:len(whole)][whole])
        grams.append([c[k:len(whole) + k][whole] for k in range(n)])
    row, side = np.concatenate(at), np.repeat([0, 1], [len(x) for x in at])
    key = row
    for k in range(n):  # numbers of (row, first k tokens), renumbered so that they stay small
        token = np.concatenate([g[k] for g in grams])
        key = np.unique(key * (int(token.max(initial=0)) + 1) + token, return_inverse=True)[1].reshape(-1)
    many = int(key.max(initial=-1)) + 1
    row_of = np.zeros(many, np.int64)
    row_of[key] = row
    both = np.minimum(np.bincount(key[side == 0], minlength=many), np.bincount(key[side == 1], minlength=many))
    return np.bincount(row_of, both, count).astype(np.int64)


def _lcs_lengths(codes: list[np.ndarray], rows: list[np.ndarray], count: int) -> np.ndarray:
    """Per row: the length of the longest common subsequence; tokens that only one side has are left out first."""
    wide = int(max(c.max(initial=0) for c in codes)) + 1
    keys = [r * wide + c for c, r in zip(codes, rows)]
    kept = [np.isin(x, y) for x, y in (keys, keys[::-1])]
    lists = []
    for c, r, k in zip(codes, rows, kept):
        ends = np.concatenate([[0], np.cumsum(np.bincount(r[k], minlength=count))]).tolist()
        tokens = c[k].tolist()
        lists.append([tokens[i:j] for i, j in zip(ends, ends[1:])])
    return np.array([lcs_length(x, y) for x, y in zip(*lists)], np.int64)


def _hits(ns: Sequence[int], lcs: bool) -> Callable[[Column, Column], Column]:
    """(candidate tokens, reference tokens) -> array: overlap of n-grams for each of ``ns``, then the LCS length."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def hits(a: pa.Array, b: pa.Array) -> pa.Array:
        codes, rows = _coded(a, b)
        found = [_overlap(codes, rows, n, len(a)) for n in ns] + ([_lcs_lengths(codes, rows, len(a))] if lcs else [])
        wide = len(found)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * wide, pa.int32()), pa.array(np.stack(found, axis=1).reshape(-1), pa.int32()))
    return hits


def rouge_columns(df: DataFrame, cand: str, ref: str, kinds=("rouge1", "rouge2", "rougeL"),
                  stem: bool = False) -> DataFrame:
    """Adds one P/R/F struct column per ROUGE kind."""
    ct, rt = rouge_tokens(F.col(cand), stem), rouge_tokens(F.col(ref), stem)
    df = df.withColumn("_ct", ct).withColumn("_rt", rt)
    ns = [int(k[len("rouge"):]) for k in kinds if not k.startswith("rougeL")]
    if ns or "rougeL" in kinds:
        df = df.withColumn("_hits", _hits(ns, "rougeL" in kinds)(F.col("_ct"), F.col("_rt")))
    size = lambda c, n: F.greatest(F.size(c) - (n - 1), F.lit(0))
    for k in kinds:
        if k == "rougeL":
            df = df.withColumn(k, prf(F.col("_hits")[len(ns)], F.size("_ct"), F.size("_rt")))
        elif k == "rougeLsum":
            df = df.withColumn(k, rouge_lsum(F.col(cand), F.col(ref), stem))
        else:
            n = int(k[len("rouge"):])
            df = df.withColumn(k, prf(F.col("_hits")[ns.index(n)], size("_ct", n), size("_rt", n)))
    return df.drop("_ct", "_rt", "_hits")


def bleu(df: DataFrame, cand: str, ref: str, group_by=(), max_n: int = 4) -> DataFrame:
    """Corpus BLEU per group: clipped n-gram precisions (n<=4), geometric
    mean, brevity penalty exp(1 - r/c) when c <= r.  Per-row counts are
    partial-aggregated (map-side) before the group shuffle."""
    ct, rt = rouge_tokens(F.col(cand)), rouge_tokens(F.col(ref))
    rows = df.select(*group_by, ct.alias("_ct"), rt.alias("_rt"))
    aggs = [F.sum(F.size("_ct")).alias("c_len"), F.sum(F.size("_rt")).alias("r_len")]
    for n in range(1, max_n + 1):
        aggs.append(F.sum(clipped_overlap(ngrams("_ct", n), ngrams("_rt", n))).alias(f"m{n}"))
        aggs.append(F.sum(F.size(ngrams("_ct", n))).alias(f"t{n}"))
    g = rows.groupBy(*group_by).agg(*aggs) if group_by else rows.agg(*aggs)
    logp = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, max_n + 1)), F.lit(0.0)) / max_n
    ok = F.lit(True)
    for n in range(1, max_n + 1):
        ok = ok & (F.col(f"m{n}") > 0)
    bp = F.when(F.col("c_len") > F.col("r_len"), F.lit(1.0)) \
        .otherwise(F.exp(1 - F.col("r_len") / F.col("c_len")))
    score = F.when(ok & (F.col("c_len") > 0), bp * F.exp(logp)).otherwise(F.lit(0.0))
    return g.select(*group_by, F.col("c_len"), F.col("r_len"), score.alias("bleu"))

"""Sequence packing (I8, I9) and the length filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["pack_gpt", "pack_lm", "filter_by_length", "validate_equal", "GPT_IDS", "LM_IDS"]

# Special ids of the GPT-style layout and of the packed-LM layout.
GPT_IDS = {"sos": 0, "pad": 1, "eos": 2, "unk": 3, "sep": 4}
LM_IDS = {"sep": 0, "pad": 0, "eos": 1}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_gpt(article_ids, summary_ids, max_len: int = 512, sos: int = 0, pad: int = 1,
             eos: int = 2, sep: int = 4) -> Column:
    """I8: ``<s> a <sep> s </s>`` + padding, and the loss mask.

    If the total exceeds max_len: available = max_len - len(s) - 3; when that
    is < 10 the summary is cut to max_len//2 and the article to max_len//2-3,
    else the article is cut to ``available``.
    """
    a, s = _c(article_ids), _c(summary_ids)
    la, ls = F.size(a), F.size(s)
    over = la + ls + 3 > max_len
    avail = F.lit(max_len) - ls - 3
    tight = over & (avail < 10)
    s2 = F.when(tight, F.slice(s, 1, max_len // 2)).otherwise(s)
    a2 = (F.when(tight, F.slice(a, 1, max(max_len // 2 - 3, 0)))
          .when(over, F.slice(a, F.lit(1), F.greatest(avail, F.lit(0)))).otherwise(a))
    ids = F.concat(F.array(F.lit(sos)), a2, F.array(F.lit(sep)), s2, F.array(F.lit(eos)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(a2) + 2), F.array_repeat(F.lit(1), F.size(s2) + 1))
    npad = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), npad)).alias("input_ids"),
                    F.concat(mask, F.array_repeat(F.lit(0), npad)).alias("loss_mask"))


def pack_lm(article_ids, summary_ids, eos: int = 1, sep: int = 0) -> Column:
    """Article + [EOS, SEP] + summary + [EOS]; mask 0 over article+2, 1 over summary+1."""
    a, s = _c(article_ids), _c(summary_ids)
    tokens = F.concat(a, F.array(F.lit(eos), F.lit(sep)), s, F.array(F.lit(eos)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(a) + 2), F.array_repeat(F.lit(1), F.size(s) + 1))
    return F.struct(tokens.alias("tokens"), mask.alias("mask"), F.size(tokens).alias("length"))


def filter_by_length(df: DataFrame, col: str, max_len: int = 2048) -> DataFrame:
    """Drop sequences longer than ``max_len`` (works on streams too)."""
    return df.where(F.size(F.col(col)) <= max_len)


def validate_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where the two arrays differ (empty result = assertion holds)."""
    return df.where(~F.coalesce(F.col(a) == F.col(b), F.lit(False)))

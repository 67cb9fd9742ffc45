"""Sequence encoding (I2, I6, I7) and length statistics (D3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.functions.arrays import decoder_input, decoder_target, pad_ids, truncate_ids
from precis.functions.text import add_prefix, whitespace_tokens
from precis.operators.vocab import EOS, PAD, SOS, UNK, encode_columns

__all__ = ["encode_pairs_word", "encode_pairs_ids", "tokenize_map", "length_stats"]


def encode_pairs_ids(df: DataFrame, src_ids: str, tgt_ids: str, max_src: int = 200, max_tgt: int = 50,
                     pad: int = PAD, sos: int = SOS, eos: int = EOS, key: str = "id") -> DataFrame:
    """I2 / I6 layout over given id arrays: src = ids[:max_src-2] padded to
    max_src; trg = [SOS]+t padded/cut to max_tgt; trg_y = t+[EOS] padded/cut,
    with t = target ids[:max_tgt-2]."""
    t = truncate_ids(tgt_ids, max_tgt - 2)
    return df.select(
        key,
        pad_ids(truncate_ids(src_ids, max_src - 2), max_src, pad).alias("src"),
        pad_ids(decoder_input(t, sos), max_tgt, pad).alias("trg"),
        pad_ids(decoder_target(t, eos), max_tgt, pad).alias("trg_y"))


def encode_pairs_word(df: DataFrame, vocab: DataFrame, max_src: int = 200, max_tgt: int = 50,
                      source: str = "source", target: str = "target", key: str = "id") -> DataFrame:
    """Whitespace tokens -> vocabulary ids (UNK = 3) -> fixed-size arrays.
    Tokens beyond the cut never leave the map side."""
    toks = df.select(key, whitespace_tokens(F.col(source)).alias("_st"),
                     whitespace_tokens(F.col(target)).alias("_tt"))
    ids = encode_columns(toks, [("_st", "_si", max_src - 2), ("_tt", "_ti", max_tgt - 2)], vocab, key, UNK)
    return encode_pairs_ids(ids, "_si", "_ti", max_src, max_tgt, key=key)


def tokenize_map(df: DataFrame, vocab: DataFrame, max_input: int = 512, max_label: int = 128,
                 prefix: str | None = None, source: str = "source", target: str = "target",
                 key: str = "id") -> DataFrame:
    """Optional task prefix, inputs cut at ``max_input`` and labels at
    ``max_label`` (no padding: collation pads per batch, see H26)."""
    src = add_prefix(F.col(source), prefix) if prefix else F.col(source)
    toks = df.select(key, whitespace_tokens(src).alias("_st"), whitespace_tokens(F.col(target)).alias("_tt"))
    return encode_columns(toks, [("_st", "input_ids", max_input), ("_tt", "labels", max_label)], vocab, key, UNK)


def length_stats(df: DataFrame, text: str, limit: int, group_by: Sequence[str] = (),
                 quantiles: Sequence[float] = ()) -> DataFrame:
    """D3: token-count distribution and the share of rows cut by ``limit``;
    ``quantiles`` adds approximate percentiles (bounded-memory sketch)."""
    n = F.size(whitespace_tokens(F.col(text)))
    x = df.select(*group_by, n.alias("_n"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.round(F.avg("_n"), 6).alias("avg_tokens"),
            F.min("_n").cast("bigint").alias("min_tokens"), F.max("_n").cast("bigint").alias("max_tokens"),
            F.round(F.avg(F.when(F.col("_n") > limit, 1.0).otherwise(0.0)), 6).alias("share_over")]
    if quantiles:
        aggs.append(F.percentile_approx("_n", list(quantiles), 10000).alias("quantiles"))
    return x.groupBy(*group_by).agg(*aggs) if group_by else x.agg(*aggs)

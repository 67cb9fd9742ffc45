"""Word vocabulary (D1, F1, E1, I1), id look-ups (C1, C2) and D14.

Counting is one explode + hash aggregate with map-side combine, so a very
frequent word costs one partial row per partition.  The ranked vocabulary is
bounded by ``max_size``: ``orderBy(...).limit`` plans as TakeOrderedAndProject
(per-partition top-k, then a k-row merge) and ids are numbered over that
bounded result only.  Look-ups send the vocabulary to the workers after
checking its size and encode whole list columns inside the Arrow batch, so no
token becomes a row; beyond that size only the part that the table uses is
sent, and beyond that too, tokens are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.functions.text import whitespace_tokens

__all__ = ["WORD_SPECIALS", "PAD", "SOS", "EOS", "UNK", "union_texts", "word_counts", "top_words",
           "build_vocab", "bounded_broadcast", "encode_columns", "lookup_ids", "lookup_tokens", "unk_rate", "token_positions"]

# Special tokens of the word scheme, in id order.
WORD_SPECIALS = ("<PAD>", "<SOS>", "<EOS>", "<UNK>")
PAD, SOS, EOS, UNK = 0, 1, 2, 3

BROADCAST_MAX_BYTES = 64 << 20


def union_texts(df: DataFrame, cols: Sequence[str] = ("source", "target"), id_col: str = "id") -> DataFrame:
    """All texts of ``cols[0]`` followed by those of ``cols[1]`` …; the
    ``part`` / ``row_key`` columns keep that order for first-appearance ties."""
    parts = [df.select(F.lit(i).alias("part"), F.col(id_col).alias("row_key"), F.col(c).alias("text"))
             for i, c in enumerate(cols)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_positions(texts: DataFrame) -> DataFrame:
    """(part, row_key, pos, token) — ``str.split()`` tokens with positions (B4:
    null texts produce none)."""
    return texts.where(F.col("text").isNotNull()).select(
        "part", "row_key", F.posexplode(whitespace_tokens(F.col("text"))).alias("pos", "token"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(token, freq, first) where ``first`` = earliest (part, row_key, pos)."""
    return token_positions(texts).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"),
        F.min(F.struct("part", "row_key", "pos")).alias("first"))


def top_words(counts: DataFrame, k: int) -> DataFrame:
    """``most_common(k)`` — count desc, ties by first appearance."""
    return counts.orderBy(F.desc("freq"), F.asc("first")).limit(k)


def build_vocab(df: DataFrame, cols: Sequence[str] = ("source", "target"), max_size: int = 20000,
                specials: Sequence[str] = WORD_SPECIALS, id_col: str = "id") -> DataFrame:
    """(token, token_id, freq): specials first (0..3), then the top words
    in rank order; a word equal to a special keeps the special's id."""
    top = top_words(word_counts(union_texts(df, cols, id_col)), max_size)
    sp = F.array(*[F.lit(s) for s in specials])
    ranked = top.where(~F.array_contains(sp, F.col("token")))
    # bounded (<= max_size rows): a global window over it is a small job
    w = Window.orderBy(F.desc("freq"), F.asc("first"))
    words = ranked.select("token", (F.row_number().over(w) + F.lit(len(specials) - 1)).alias("token_id"),
                          F.col("freq").cast("bigint").alias("freq"))
    spark = df.sparkSession
    spec = spark.createDataFrame([(s, i, 0) for i, s in enumerate(specials)], "token string, token_id int, freq bigint")
    return spec.unionByName(words.select("token", F.col("token_id").cast("int"), "freq"))


def _bytes_of(df: DataFrame) -> int:
    """Payload of a small table, as text and 8 bytes a value."""
    return df.select(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8
                          for c in df.columns), F.lit(0)).alias("b")).agg(F.sum("b")).first()[0] or 0


def bounded_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``small`` only if its measured payload is under ``max_bytes``."""
    return F.broadcast(small) if _bytes_of(small) <= max_bytes else small


def _dictionary(df: DataFrame, cols: Sequence[str], table: DataFrame, from_col: str, to_col: str,
                max_bytes: int) -> pa.Table | None:
    """(from, to) rows of ``table`` for a worker's look-up: all of them if they fit, else those whose key is among the
    distinct values of the list columns, else None."""
    t = table.select(F.col(from_col).alias("k"), F.col(to_col).alias("v"))
    if _bytes_of(t) > max_bytes:
        used = df.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array()) for c in cols])).alias("k")).distinct()
        t = t.join(used, "k", "left_semi").checkpoint()
        if _bytes_of(t) > max_bytes:
            return None
    return t.dropDuplicates(["k"]).toArrow()


def _looked_up(df: DataFrame, specs: Sequence[tuple[str, str]], key: str, table: pa.Table, kind: str, missing) -> DataFrame:
    """(key, out...): list columns mapped through ``table`` inside the Arrow batch.  A column is flattened, encoded
    against the dictionary as a whole, and takes its old offsets back: no token becomes a row, nothing is shuffled.
    Values that the dictionary lacks are ``missing``; a null list is empty, a null element stays null."""
    held = df.sparkSession.sparkContext.broadcast((table.column("k").combine_chunks(), table.column("v").combine_chunks()))
    names = [key, *[out for _, out in specs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = held.value
        for b in batches:
            arrays = [b.column(0)]
            for i in range(1, b.num_columns):
                lists = b.column(i)
                flat = lists.flatten().cast(keys.type)
                ids = pc.fill_null(values.take(pc.index_in(flat, value_set=keys)), pa.scalar(missing, values.type))
                ids = pc.if_else(flat.is_null(), pa.scalar(None, values.type), ids)
                size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
                ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, ids))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    cols = df.select(key, *[F.col(c).alias(out) for c, out in specs])
    first = f"`{key}` {dict(df.dtypes)[key]}"
    return cols.mapInArrow(run, ", ".join([first, *[f"`{out}` array<{kind}>" for _, out in specs]]))


def encode_columns(df: DataFrame, specs: Sequence[tuple[str, str, int | None]], vocab: DataFrame,
                   key: str = "id", unk: int = UNK, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """C1 for several token columns at once: ``specs`` = (tokens_col, out_col,
    max_len).  Returns (key, out...) — one row per input row.

    Tokens are cut at ``max_len`` in the JVM and looked up in the Arrow batch,
    as long as the vocabulary (or what of it the table uses) fits
    ``max_bytes``; beyond that they are joined by a shuffle.
    """
    v = vocab.select("token", F.col("token_id").cast("int").alias("token_id"))
    cut = df.select(key, *[(F.slice(F.col(t), 1, n) if n is not None else F.col(t)).alias(f"_t{i}") for i, (t, _, n) in enumerate(specs)])
    cols = [f"_t{i}" for i in range(len(specs))]
    table = _dictionary(cut, cols, v, "token", "token_id", max_bytes)
    if table is not None:
        return _looked_up(cut, [(c, out) for c, (_, out, _) in zip(cols, specs, strict=True)], key, table, "int", unk)
    return _encode_by_join(df, specs, v, key, unk)


def _encode_by_join(df: DataFrame, specs: Sequence[tuple[str, str, int | None]], vocab: DataFrame, key: str, unk: int) -> DataFrame:
    """The same by exploded tokens, for a vocabulary that no worker should hold; ``key`` names the rows."""
    v = vocab.select(F.col("token").alias("_tok"), F.col("token_id").alias("_tid"))
    parts = []
    for i, (tokens, _, max_len) in enumerate(specs):
        ex = df.select(key, F.lit(i).alias("_part"), F.posexplode_outer(F.col(tokens)).alias("_pos", "_tok"))
        if max_len is not None:
            ex = ex.where(F.col("_pos").isNull() | (F.col("_pos") < max_len))
        parts.append(ex)
    ex = parts[0]
    for p in parts[1:]:
        ex = ex.unionByName(p)
    j = ex.join(v, "_tok", "left").select(
        key, "_part", "_pos", F.when(F.col("_tok").isNull(), F.lit(None)).otherwise(
            F.coalesce("_tid", F.lit(unk))).alias("_tid"))
    aggs = []
    for i, (_, out, _) in enumerate(specs):
        item = F.when((F.col("_part") == i) & F.col("_pos").isNotNull(), F.struct("_pos", "_tid"))
        aggs.append(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_tid"]).alias(out))
    return j.groupBy(key).agg(*aggs)


def lookup_ids(df: DataFrame, tokens: str, vocab: DataFrame, out: str = "ids", key: str = "id",
               max_len: int | None = None, unk: int = UNK, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``word2index.get(token, UNK)`` for each token, order kept -> (key, out)."""
    return encode_columns(df, [(tokens, out, max_len)], vocab, key, unk, max_bytes)


def lookup_tokens(df: DataFrame, ids: str, vocab: DataFrame, out: str = "tokens", key: str = "id",
                  max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``index2word.get(id, '')`` for each id, order kept -> (key, out)."""
    v = vocab.select("token", F.col("token_id").cast("int").alias("token_id"))
    x = df.select(key, F.transform(F.col(ids), lambda i: i.cast("int")).alias("_ids"))
    table = _dictionary(x, ["_ids"], v, "token_id", "token", max_bytes)
    if table is not None:
        return _looked_up(x, [("_ids", out)], key, table, "string", "")
    ex = x.select(key, F.posexplode_outer("_ids").alias("_pos", "_tid"))
    j = ex.join(v.select(F.col("token").alias("_tok"), F.col("token_id").alias("_tid")), "_tid", "left").select(
        key, "_pos", F.coalesce("_tok", F.lit("")).alias("_tok"))
    item = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_tok"))
    return j.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_tok"]).alias(out))


def unk_rate(df: DataFrame, tokens: str, vocab: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Share of tokens outside the vocabulary (no regroup: token rows are
    joined and aggregated directly)."""
    v = bounded_broadcast(vocab.select(F.col("token").alias("_tok"), F.lit(1).alias("_known")))
    ex = df.select(*group_by, F.explode(F.col(tokens)).alias("_tok"))
    j = ex.join(v, "_tok", "left")
    unk = F.when(F.col("_known").isNull(), 1).otherwise(0)
    aggs = [F.count(F.lit(1)).alias("tokens"), F.sum(unk).cast("bigint").alias("unknown"),
            F.round(F.avg(unk), 6).alias("unk_rate")]
    return j.groupBy(*group_by).agg(*aggs) if group_by else j.agg(*aggs)

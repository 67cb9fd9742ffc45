"""Byte-level BPE: training on Spark (I3, I4, D11), encode / decode.

Training
  1. pre-tokenize every text (GPT-2 style pattern, JVM regex) and count the
     distinct pre-tokens — one explode + hash aggregate, map-side combined;
  2. map each pre-token to byte-symbol ids (ids 5..260 for the 256 byte
     symbols, in code-point order of their printable stand-ins);
  3. epochs on the distinct-word table, each of many exact merges:
     - count adjacent pairs weighted by frequency (D11) and take the best m
       (count desc, lowest left id, lowest right id); the m-th is the *floor*;
     - cut every word at the pairs below the floor and aggregate the pieces
       that are left (segments) to distinct ones with their frequencies;
     - merge greedily on the segments, by an inverted index pair -> segments
       with incremental counts, until the best pair is below the floor;
     - rewrite the words with the epoch's merges and write the table.

Why an epoch is exact: a merge only makes pairs at boundaries that were there
before.  A new pair therefore counts at most as much as the pair that stood at
its boundaries when the epoch began, and as new ids are larger than all others
it also loses the ties that the old pair loses.  So a boundary below the floor
never holds a pair that is due before the floor, and what happens down to the
floor is decided by the segments alone.  Segments are bounded: m is cut until
their distinct symbols fit ``SEGMENT_SYMBOLS`` (with m = 1 the segments are one
pair, or runs of one symbol), whatever the size of the corpus; merged words
leave the table, so it shrinks.  With ``state_dir`` the merges are written per
epoch, so an interrupted run resumes (A13, A14).

Encoding runs in an Arrow UDF (the merge table is bounded by the vocabulary
size and broadcast): the distinct pre-tokens of a batch are merged together, a
step for all of them at a time, so nothing is kept between batches and no
token is shuffled.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.functions.text import WS_CLASS

__all__ = ["BPE_SPECIALS", "byte_symbols", "symbol_ids", "PRETOKEN", "pretokens", "word_table",
           "pair_counts", "segments", "merge_segments", "train_bpe", "build_subwords", "BpeModel",
           "encode_bpe", "decode_bpe"]

# The five special tokens, in id order.
BPE_SPECIALS = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")

# Pre-tokenizer: contractions, optional-space letter/number/other runs,
# whitespace not followed by non-space, other whitespace.
_NS = r"[^" + WS_CLASS + r"]"
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WS_CLASS + r"\p{L}\p{N}]+"
            r"|[" + WS_CLASS + r"]+(?!" + _NS + r")|[" + WS_CLASS + r"]+")


def byte_symbols() -> list[str]:
    """Printable stand-in character for each byte 0..255: printable Latin-1
    bytes stand for themselves, the others are shifted to 256 + n in order."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, n = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


def symbol_ids(first_id: int = len(BPE_SPECIALS)) -> list[int]:
    """Id of each byte's symbol: ``first_id`` + rank of its stand-in character."""
    syms = byte_symbols()
    order = sorted(range(256), key=lambda b: syms[b])
    ids = [0] * 256
    for rank, b in enumerate(order):
        ids[b] = first_id + rank
    return ids


def pretokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PRETOKEN), 0)


def _byte_ids(word: Column) -> Column:
    table = F.array(*[F.lit(i) for i in symbol_ids()])
    b = F.encode(word, "UTF-8")
    return F.transform(F.sequence(F.lit(1), F.octet_length(b)),
                       lambda i: F.element_at(table, F.conv(F.hex(F.substring(b, i, 1)), 16, 10).cast("int") + 1))


def word_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(word, freq, syms): distinct pre-tokens of the given text columns."""
    ex = df.select(F.explode(F.concat(*[pretokens(c) for c in cols])).alias("word"))
    w = ex.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return w.select("word", "freq", _byte_ids(F.col("word")).alias("syms"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, count) over adjacent symbols, weighted by frequency."""
    s = F.col("syms")
    pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                       lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    ex = words.where(F.size(s) >= 2).select("freq", F.explode(pairs).alias("p"))
    return ex.groupBy("p.left", "p.right").agg(F.sum("freq").alias("count"))


#: Distinct symbols of an epoch's segments at most, and pairs that an epoch starts from and takes at most.
SEGMENT_SYMBOLS, FIRST_PAIRS, MOST_PAIRS = 1 << 20, 1 << 9, 1 << 13


def _key(left, right):
    """A pair as one number; numbers sort like (left, right)."""
    return (left << 32) | right


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (values, offsets)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0]:offsets[-1]].astype(np.int64), offsets - offsets[0]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as (bytes, offsets)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _runs(values: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the longest runs of two or more symbols, inside one word, whose adjacent pairs are all in ``keys``."""
    linked = np.zeros(len(values) + 1, bool)  # linked[i]: symbols i - 1 and i are joined
    if len(values) > 1:
        pair = _key(values[:-1], values[1:])
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        linked[1:-1] = keys[at] == pair
        linked[offsets[(offsets > 0) & (offsets < len(values))]] = False
    first = np.flatnonzero(~linked[:-1] & linked[1:])
    end = np.flatnonzero(linked[:-1] & ~linked[1:]) + 1
    return first, end


def segments(words: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(seg, freq): distinct maximal runs of symbols joined by ``pairs``; ``seg`` holds little-endian 32-bit ids."""
    keys = words.sparkSession.sparkContext.broadcast(np.array(sorted(_key(l_, r_) for l_, r_ in pairs), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, offsets = _flat(b.column(b.schema.get_field_index("syms")))
            freq = b.column(b.schema.get_field_index("freq")).to_numpy()
            first, end = _runs(values, offsets, keys.value)
            of = freq[np.searchsorted(offsets, first, side="right") - 1]
            ends = np.concatenate([[0], np.cumsum(end - first)])
            held = values[np.repeat(first - ends[:-1], end - first) + np.arange(ends[-1])].astype("<i4")
            seg = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(held)])
            found = pa.table({"seg": seg, "freq": pa.array(of, pa.int64())}).group_by("seg").aggregate([("freq", "sum")])
            yield from found.select(["seg", "freq_sum"]).rename_columns(["seg", "freq"]).to_batches()

    return words.select("syms", "freq").mapInArrow(run, "seg binary, freq bigint").groupBy("seg").agg(F.sum("freq").alias("freq"))


def merged(syms: list[int], left: int, right: int, new: int) -> list[int]:
    """Adjacent (left, right) replaced by ``new``, left to right, non-overlapping."""
    out, i, last = [], 0, len(syms) - 1
    while i <= last:
        if i < last and syms[i] == left and syms[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def merge_segments(table: list[tuple[list[int], int]], next_id: int, room: int, floor: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Greedy merges on (symbols, frequency) rows until the best pair comes after ``floor`` (count, key) or ``room``
    merges are made: an inverted index pair -> rows, counts kept up to date per rewritten row."""
    counts: dict[int, int] = {}
    where: dict[int, set[int]] = {}
    rows = [list(s) for s, _ in table]
    freq = [f for _, f in table]
    for i, syms in enumerate(rows):
        for a, b in zip(syms, syms[1:]):
            k = _key(a, b)
            counts[k] = counts.get(k, 0) + freq[i]
            where.setdefault(k, set()).add(i)
    heap = [(-c, k) for k, c in counts.items()]
    heapq.heapify(heap)
    limit = (-floor[0], floor[1])
    out: list[tuple[int, int, int]] = []
    while heap and len(out) < room and heap[0] <= limit:
        count, key = heapq.heappop(heap)
        now = counts.get(key, 0)
        if now != -count:
            if now > 0:
                heapq.heappush(heap, (-now, key))
            continue
        left, right, new = key >> 32, key & 0xFFFFFFFF, next_id + len(out)
        out.append((left, right, new))
        changed: dict[int, int] = {}
        for i in where.pop(key):
            old = rows[i]
            syms = merged(old, left, right, new)
            if len(syms) == len(old):
                continue
            for a, b in zip(old, old[1:]):
                k = _key(a, b)
                changed[k] = changed.get(k, 0) - freq[i]
            for a, b in zip(syms, syms[1:]):
                k = _key(a, b)
                changed[k] = changed.get(k, 0) + freq[i]
                if a == new or b == new:
                    where.setdefault(k, set()).add(i)
            rows[i] = syms
        for k, d in changed.items():
            if d:
                counts[k] = counts.get(k, 0) + d
                if d > 0:
                    heapq.heappush(heap, (-counts[k], k))
        counts.pop(key, None)
    return out


#: Bits of the hash by which a merge is looked up.
SLOT_BITS = 20


class MergeTable:
    """Merges (left, right, new id) in rank order, to be applied to many words at once."""

    def __init__(self, merges: Sequence[tuple[int, int, int]]):
        self.rank = {(l_, r_): (i, n) for i, (l_, r_, n) in enumerate(merges)}
        rows = sorted((_key(l_, r_), i) for (l_, r_), (i, _) in self.rank.items())
        self.keys, self.ranks = (np.array([r[k] for r in rows], np.int64) for k in range(2))
        self.new = np.array([n for _, _, n in merges], np.int64)  # by rank
        # where a hash of a pair leads: its place among the keys, -1 for none, -2 where several keys meet
        slot = self._slot(self.keys)
        self.place = np.full(1 << SLOT_BITS, -1, np.int32)
        self.place[slot] = np.arange(len(slot))
        self.place[np.flatnonzero(np.bincount(slot, minlength=1) > 1)] = -2

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank_of(self, pair: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges for a pair that is none of them."""
        at = self.place[self._slot(pair)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.keys, pair[several]), len(self.keys) - 1)
        maybe = np.flatnonzero(at >= 0)
        maybe = maybe[self.keys[at[maybe]] == pair[maybe]]
        out = np.full(len(pair), len(self.new), np.int64)
        out[maybe] = self.ranks[at[maybe]]
        return out

    def apply(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words (values, offsets) after the merges, lowest rank first.

        A round makes the lowest merge of every word that has one, left to right and non-overlapping; words without one
        are set aside.  Words of more than LONG_WORD symbols would take many rounds: they are merged one by one."""
        size, none = np.diff(offsets), len(self.new)
        if not len(size) or not none:
            return values, offsets
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word numbers, sizes, values)
        word = np.arange(len(size))
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            x = np.array(_ranked_long(values[offsets[w]:offsets[w + 1]].tolist(), self.rank), np.int64)
            done.append((np.array([w]), np.array([len(x)]), x))
        some = (size > 0) & (size <= LONG_WORD)
        values, word, size = values[np.repeat(some, size)], word[some], size[some]
        while len(word):
            starts = np.cumsum(size) - size
            rank = np.full(len(values), none, np.int64)  # of the pair that begins here
            if len(values) > 1:
                rank[:-1] = self.rank_of(_key(values[:-1], values[1:]))
                rank[starts[1:] - 1] = none  # no pair crosses words
            best = np.minimum.reduceat(rank, starts)
            go = best < none
            if not go.all():
                keep = np.repeat(go, size)
                done.append((word[~go], size[~go], values[~keep]))
                values, rank, word, size, best = values[keep], rank[keep], word[go], size[go], best[go]
                if not len(word):
                    break
                starts = np.cumsum(size) - size
            hit = rank == np.repeat(best, size)
            # neighbours that both begin the pair are a run of one symbol: every second one is merged
            first = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            at = np.flatnonzero(hit)
            values = values.copy()
            values[at] = self.new[rank[at]]
            left = np.ones(len(values), bool)
            left[at + 1] = False
            size = np.add.reduceat(left.astype(np.int64), starts)
            values = values[left]
        empty = np.flatnonzero(np.diff(offsets) == 0)
        done.append((empty, np.zeros(len(empty), np.int64), np.zeros(0, np.int64)))
        word, size = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        ends = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(word)
        size = size[order]
        out = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(ends[:-1][order] - out[:-1], size) + np.arange(out[-1])
        return np.concatenate([d[2] for d in done])[take], out


def _rewritten(words: DataFrame, merges: Sequence[tuple[int, int, int]]) -> DataFrame:
    """``words`` after ``merges`` (in order); words of one symbol leave."""
    spark = words.sparkSession
    table = spark.sparkContext.broadcast(list(merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # symbols made by these merges have no pairs in the table yet: a run is joined by old pairs alone
        t = MergeTable(table.value)
        for b in batches:
            if not b.num_rows:
                continue
            values, offsets = t.apply(*_flat(b.column(b.schema.get_field_index("syms"))))
            syms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            keep = pa.array(np.diff(offsets) >= 2)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("freq")).filter(keep), syms.filter(keep)], names=["freq", "syms"])

    return words.select("freq", "syms").mapInArrow(run, "freq bigint, syms array<int>")


#: Symbols of a word from which it is merged by itself.
LONG_WORD = 256


def _ranked_long(syms: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """One word after the merges, by a heap of its pairs (rank, place) and a linked list of its symbols."""
    n = len(syms)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank[p][0], i, p) for i, p in enumerate(zip(syms, syms[1:])) if p in rank]
    heapq.heapify(heap)
    syms = list(syms)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if syms[i] is None or j < 0 or (syms[i], syms[j]) != pair:
            continue
        syms[i], syms[j] = rank[pair][1], None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (p := (syms[k], syms[after[k]])) in rank:
                heapq.heappush(heap, (rank[p][0], k, p))
    return [x for x in syms if x is not None]


class BpeModel:
    """Merges (rank order) and token strings; bounded by the vocabulary size."""

    def __init__(self, merges: list[tuple[int, int, int]], specials: Sequence[str] = BPE_SPECIALS):
        self.specials = list(specials)
        self.merges = merges                       # (left, right, new_id)
        syms, ids = byte_symbols(), symbol_ids(len(specials))
        self.token = {i: s for i, s in enumerate(self.specials)}
        self.bytes_of: dict[int, bytes] = {}
        for b in range(256):
            self.token[ids[b]] = syms[b]
            self.bytes_of[ids[b]] = bytes([b])
        for l_, r_, n in merges:
            self.token[n] = self.token[l_] + self.token[r_]
            self.bytes_of[n] = self.bytes_of[l_] + self.bytes_of[r_]
        self.byte_id = ids

    @property
    def vocab_size(self) -> int:
        return len(self.token)

    def merges_text(self) -> list[str]:
        return [f"{self.token[l_]} {self.token[r_]}" for l_, r_, _ in self.merges]

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted((t, i) for i, t in self.token.items()), "token string, id int")

    @classmethod
    def from_tables(cls, vocab: DataFrame, merges: DataFrame, specials: Sequence[str] = BPE_SPECIALS) -> "BpeModel":
        """A10: the model of ``bpe_vocab(token, id)`` and ``bpe_merges(rank, left, right)``; both are bounded by
        the vocabulary size.  A merge whose parts or whole are no tokens is an error."""
        id_of = {r["token"]: r["id"] for r in vocab.collect()}
        rows = merges.orderBy("rank").collect()
        missing = [r["left"] + " " + r["right"] for r in rows if not {r["left"], r["right"], r["left"] + r["right"]} <= id_of.keys()]
        if missing:
            raise ValueError(f"merges of tokens that the vocabulary lacks: {missing[:3]}")
        model = cls([(id_of[r["left"]], id_of[r["right"]], id_of[r["left"] + r["right"]]) for r in rows], specials)
        if model.token != {i: t for t, i in id_of.items()}:
            raise ValueError("the vocabulary is not the special tokens, the byte symbols and the merges in order")
        return model

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r, self.token[l_], self.token[r_], l_, r_, n) for r, (l_, r_, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string, left_id int, right_id int, id int")


def train_bpe(df: DataFrame, cols: Sequence[str], vocab_size: int = 30000, min_frequency: int = 2,
              specials: Sequence[str] = BPE_SPECIALS, state_dir: str | None = None,
              segment_symbols: int = SEGMENT_SYMBOLS, first_pairs: int = FIRST_PAIRS) -> BpeModel:
    """Byte-level BPE merges learnt from the text columns of ``df``, until ``vocab_size`` or until no pair
    occurs ``min_frequency`` times.  Equal to merging one best pair at a time."""
    from precis.session import scratch_path
    from precis.sources.files import drop_path, load_round, resume_from, save_round
    spark = df.sparkSession
    base = len(specials) + 256
    merges: list[tuple[int, int, int]] = []
    start = resume_from(spark, state_dir) if state_dir else -1
    words = word_table(df, cols).where(F.size("syms") >= 2).select("freq", "syms")
    if start >= 0:
        m = load_round(spark, state_dir, start).orderBy("rank").collect()
        merges = [(r.left_id, r.right_id, r.id) for r in m][:max(vocab_size - base, 0)]
        words = _rewritten(words, merges)
    sc, folder = spark.sparkContext, scratch_path(spark, f"bpe-{uuid.uuid4().hex[:12]}")
    # the table may be small in bytes but every row is Python work: it is not left to one partition
    parts = max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = words.repartition(parts)
    take, epoch = first_pairs, 0
    while True:
        words.write.parquet(f"{folder}/epoch={epoch}")
        words = spark.read.schema("freq bigint, syms array<int>").parquet(f"{folder}/epoch={epoch}")
        if epoch > 1:
            drop_path(spark, f"{folder}/epoch={epoch - 2}")  # the table before last feeds nothing any more
        room = vocab_size - base - len(merges)
        found = [] if room <= 0 else pair_counts(words).where(F.col("count") >= min_frequency).orderBy(
            F.desc("count"), F.asc("left"), F.asc("right")).limit(take).collect()
        if not found:
            drop_path(spark, folder)
            return BpeModel(merges, specials)
        while True:  # fewer pairs until the segments fit
            last = found[-1]
            floor = (last["count"], _key(last["left"], last["right"])) if len(found) == take else (min_frequency, 1 << 64)
            seg = segments(words, [(r["left"], r["right"]) for r in found]).persist()
            size = seg.agg(F.sum(F.octet_length("seg") / 4)).first()[0] or 0
            if size <= segment_symbols or take == 1:
                break
            seg.unpersist()
            take = max(1, min(take, len(found)) // 4)
            found = found[:take]
        rows = seg.collect()  # at most segment_symbols symbols
        seg.unpersist()
        new = merge_segments([(np.frombuffer(r["seg"], "<i4").tolist(), r["freq"]) for r in rows], base + len(merges), room, floor)
        merges += new
        words = _rewritten(words, new)
        if state_dir:
            save_round(BpeModel(merges, specials).merges_df(spark), state_dir, len(merges))
        if size < segment_symbols / 4:
            take = min(2 * take, MOST_PAIRS)
        epoch += 1


def build_subwords(df: DataFrame, cols: Sequence[str], target: int = 32768, state_dir: str | None = None) -> BpeModel:
    """I4: a sub-word vocabulary of ``target`` entries; its first merges are those of any smaller vocabulary."""
    return train_bpe(df, cols, target, 2, state_dir=state_dir)


#: Models and encoders of this worker by the tag of their broadcast.
_WORKER: dict[tuple, object] = {}


def _once(key: tuple, build):
    if key not in _WORKER:
        if len(_WORKER) >= 4:
            _WORKER.clear()
        _WORKER[key] = build()
    return _WORKER[key]


def _encoded(words: pa.Array, table: MergeTable, byte_id: np.ndarray) -> pa.Array:
    """Lists of pre-tokens -> lists of ids; every distinct pre-token is merged once, a null list is empty."""
    per_row = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = pc.list_flatten(words).dictionary_encode()
    data, off = _bytes(coded.dictionary)
    values, offsets = table.apply(byte_id[data], off)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    at = coded.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[at])])
    return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(per_row)])], pa.int32()), lists.take(coded.indices).flatten())


def encode_bpe(spark: SparkSession, text, model: BpeModel) -> Column:
    """I5 encode: text -> BPE ids (pre-tokens in the JVM, merges in an Arrow UDF; the model is broadcast)."""
    bc, tag, byte_id = spark.sparkContext.broadcast(model.merges), uuid.uuid4().hex, np.array(model.byte_id, np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def enc(words: pa.Array) -> pa.Array:
        return _encoded(words, _once(("table", tag), lambda: MergeTable(bc.value)), byte_id)
    return enc(pretokens(text))


def _decoded(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Lists of ids -> text: the bytes of ``pieces`` by id, invalid UTF-8 replaced; other ids and a null list give none."""
    per_row = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < len(pieces))
    found = pieces.take(pa.array(np.where(known, flat, 0)))  # id 0 is a special token: no bytes
    data, off = _bytes(found)
    ends = off[np.concatenate([[0], np.cumsum(per_row)])]
    whole = data.tobytes()
    return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


def decode_bpe(spark: SparkSession, ids, model: BpeModel) -> Column:
    """I5 decode: ids -> text, special ids skipped, invalid UTF-8 replaced."""
    bc, tag, specials = spark.sparkContext.broadcast(model.merges), uuid.uuid4().hex, model.specials

    def build() -> pa.Array:
        m = BpeModel(bc.value, specials)
        return pa.array([m.bytes_of.get(i, b"") if i >= len(specials) else b"" for i in range(max(m.token) + 1)], pa.binary())

    @F.arrow_udf(T.StringType())
    def dec(col: pa.Array) -> pa.Array:
        return _decoded(col, _once(("pieces", tag), build))
    c = F.col(ids) if isinstance(ids, str) else ids
    return dec(c)

"""Best-fit packing by swap-based local search (operator 7).

Documents become token pieces of at most ``capacity`` ids; pieces are packed
into as few sequences as the search finds.  A packing only depends on how many
pieces there are of each length, so the search runs on that histogram (at most
``capacity`` rows, whatever the corpus size): a *bin type* is a multiset of
lengths with the number of bins that look like it.

1. best-fit decreasing on the histogram gives the first bin types;
2. local search: between underfull bin types, a piece is moved, exchanged one
   for one or two for one whenever that raises the sum of squared fills; the
   emptiest bins drain into fuller ones until they vanish or nothing improves;
3. Spark numbers the pieces of each length (salted, so that one very frequent
   length is many tasks) and joins the numbers with the slots of that length.

Defined results: null or empty text is the single end token; repeated rows are
separate pieces; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import batch, written

__all__ = ["token_pieces", "plan_bins", "pack"]

#: Pieces of one length are counted off in SALTS sub-groups, and one more for every RANK_ROWS pieces.
SALTS, RANK_ROWS = 16, 200_000


# ---------------------------------------------------------------- tokens
def _encoder(vocab: str):
    """ids of a text under the public vocabulary ``vocab``.

    ``tiktoken`` reads the same vocabulary as ranks and is several times
    faster; text outside Latin-1 goes to ``tokenizers`` itself, so Unicode
    tables of two regular-expression engines never have to agree.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path(f"{vocab}.json"))
    special = {"<|endoftext|>": exact.token_to_id("<|endoftext|>")}
    with open(P.path(f"{vocab}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocab, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text, allowed_special="all")
    return ids


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048,
                 vocab: str = "byte_bpe_50k", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids``,
    little-endian 32-bit, with ``keep_ids``).

    A document is its ids plus ``end_id``.  Only documents beyond ``capacity``
    are cut; all pieces but the first hold exactly ``capacity`` ids.
    """
    kind = docs.schema[doc_id].dataType
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        ids_of = _encoder(vocab)
        tail = np.array([end_id], dtype="<u4")
        for b in batches:
            pos, piece, start, length, crc, blobs = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                ids = np.concatenate([ids_of(t.as_py() or ""), tail]).astype("<u4", copy=False)
                n = len(ids)
                cut, k = 0, 0
                upto = (n - 1) % capacity + 1
                while cut < n:
                    blob = ids[cut:upto].tobytes()
                    pos.append(i), piece.append(k), start.append(cut), length.append(upto - cut)
                    crc.append(zlib.crc32(blob))
                    if keep_ids:
                        blobs.append(blob)
                    cut, upto, k = upto, upto + capacity, k + 1
            out = [b.column(0).take(pa.array(pos, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return src.mapInArrow(run, schema + (", ids binary" if keep_ids else ""))


# ---------------------------------------------------------------- bins
class _Types:
    """Bin types by content: ``n[pattern]`` bins hold exactly the lengths of ``pattern`` (descending)."""

    def __init__(self):
        self.n: dict[tuple[int, ...], int] = defaultdict(int)

    def add(self, pattern, k):
        if pattern and k:
            self.n[pattern] += k

    def take(self, pattern, k):
        self.n[pattern] -= k
        if not self.n[pattern]:
            del self.n[pattern]


def _best_fit(hist: dict[int, int], capacity: int) -> _Types:
    """Best-fit decreasing with multiplicities: equal pieces are placed together."""
    types = _Types()
    by_room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(pattern, k):
        room = capacity - sum(pattern)
        if room not in by_room:
            by_room[room] = defaultdict(int)
            insort(rooms, room)
        by_room[room][pattern] += k

    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put((size,) * each, left // each) if left // each else None
                put((size,) * (left % each), 1) if left % each else None
                left = 0
                continue
            room = rooms[at]
            pattern, have = next(iter(by_room[room].items()))
            k = min(have, left)
            by_room[room][pattern] -= k
            if not by_room[room][pattern]:
                del by_room[room][pattern]
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            put(pattern + (size,), k)
            left -= k
    for found in by_room.values():
        for pattern, k in found.items():
            types.add(pattern, k)
    return types


def _improve(types: _Types, capacity: int, steps: int) -> None:
    """Swap-based local search on underfull bin types (in place).

    The emptiest type gives; every other underfull type is tried as the taker
    with each move (a piece), one-for-one and two-for-one exchange.  The step
    with the largest gain in squared fill is applied to as many bins as both
    types have.  A type that cannot give any more is set aside.
    """
    total = sum(sum(p) * k for p, k in types.n.items())
    bound = -(-total // capacity)
    done: set[tuple] = set()
    while steps > 0 and sum(types.n.values()) > bound:
        open_ = [p for p in types.n if sum(p) < capacity]
        givers = [p for p in open_ if p not in done]
        if not givers or len(open_) < 2 and types.n[open_[0]] < 2:
            return
        giver = min(givers, key=lambda p: (sum(p), p))
        fill = sum(giver)
        takers = [p for p in open_ if p != giver or types.n[p] > 1]
        if not takers:
            done.add(giver)
            continue
        fills = np.array([sum(p) for p in takers])
        # what a taker may hand back: nothing (a move) or one of its pieces
        who = np.concatenate([np.arange(len(takers)), np.repeat(np.arange(len(takers)), [len(p) for p in takers])])
        back = np.concatenate([np.zeros(len(takers), np.int64), np.array([x for p in takers for x in p], np.int64)])
        gives = {(x,) for x in giver} | {(giver[i], giver[j]) for i in range(len(giver)) for j in range(i + 1, len(giver))}
        best = (0, None, None, None)
        for out in sorted(gives):
            moved = sum(out) - back
            gain = 2 * moved * (fills[who] - fill + moved)
            ok = (moved > 0) & (fills[who] + moved <= capacity)
            if len(out) == 2:
                ok &= back > 0
            gain = np.where(ok, gain, 0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (int(gain[at]), out, takers[who[at]], int(back[at]))
        steps -= 1
        if best[1] is None:
            done.add(giver)
            continue
        _, out, taker, returned = best
        k = types.n[giver] // 2 if taker == giver else min(types.n[giver], types.n[taker])
        types.take(giver, k)
        types.take(taker, k)
        less, more = list(giver), list(taker)
        for x in out:
            less.remove(x)
            more.append(x)
        if returned:
            more.remove(returned)
            less.append(returned)
        types.add(tuple(sorted(less, reverse=True)), k)
        types.add(tuple(sorted(more, reverse=True)), k)
        done.discard(giver)


def plan_bins(hist: dict[int, int], capacity: int = 2048, steps: int = 4000) -> list[tuple[tuple[int, ...], int]]:
    """Bin types (lengths in a bin, number of such bins) that hold all pieces of ``hist`` (length -> pieces).

    ``steps`` bounds the effort of the search, never the pieces it places.
    """
    types = _best_fit({int(k): int(v) for k, v in hist.items() if v}, capacity)
    _improve(types, capacity, steps)
    return sorted(types.n.items(), reverse=True)


# ---------------------------------------------------------------- assignment
def _numbered(pieces: DataFrame, hist: DataFrame) -> DataFrame:
    """``nth`` (from 0) among the pieces of the same length; a frequent length is spread over salted sub-groups."""
    many = hist.select("length", F.floor(F.col("n") / RANK_ROWS + SALTS).alias("_salts"))
    p = pieces.join(F.broadcast(many), "length").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts"))).drop("_salts")
    before = p.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return p.withColumn("_nth", F.row_number().over(order) - 1).join(before, ["length", "_salt"]).withColumn(
        "nth", F.col("_nth") + F.col("_before")).drop("_salt", "_nth", "_before")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048,
         vocab: str = "byte_bpe_50k", end_id: int = 0, steps: int = 4000, keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: the columns of :func:`token_pieces`, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, text, doc_id, capacity, vocab, end_id, keep_ids), "pieces")
    hist = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in hist.collect()}  # at most `capacity` rows
    hist = spark.createDataFrame(sorted(counts.items()), "length bigint, n bigint")
    slots, first, used = [], 0, defaultdict(int)
    for pattern, k in plan_bins(counts, capacity, steps):
        offset = 0
        for size in pattern:
            slots.append((size, used[size], used[size] + k, first - used[size], offset))
            used[size] += k
            offset += size
        first += k
    places = spark.createDataFrame(slots, "length bigint, lo bigint, hi bigint, shift bigint, offset bigint")
    numbered = _numbered(pieces, hist)
    same = (numbered["length"] == places["length"]) & (numbered["nth"] >= places["lo"]) & (numbered["nth"] < places["hi"])
    return numbered.join(F.broadcast(places), same).select(
        *[numbered[c] for c in pieces.columns], (numbered["nth"] + places["shift"]).alias("sequence_id"), places["offset"])

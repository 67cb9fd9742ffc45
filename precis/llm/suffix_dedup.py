"""Removal of repeated byte strings by a suffix sort (operator 1).

Contract: a byte goes if it is covered by a ``length``-byte string that also
starts anywhere else in the table (the same document included); strings are
judged on the input and never cross documents.

Sorting every suffix of 100 TB would shuffle the corpus several times over, so
suffixes are sorted only from *anchors*: in every window of ``length`` bytes,
the position of the least ``GRAM``-byte hash (winnowing).  Equal windows have
equal anchors at equal places, so nothing is lost:

1. every anchor has its gram hash and a digest of its *context*, the bytes that
   windows around it can reach; counts per (gram, context) are aggregated;
2. an anchor whose whole context occurs twice needs no further look; grams with
   several contexts are *mixed* and one copy of each context is kept;
3. the suffixes from the anchors of one mixed gram are sorted, to the right and
   (reversed) to the left, by their bytes.  Prefix polynomial hashes and a
   binary search find neighbours' common extensions, which are verified byte by
   byte and say which windows around an anchor occur twice;
4. the spans go back to the documents and are merged.

Defined results: null or empty text has no bytes; repeated rows repeat each
other; a null id is kept as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from precis.llm.common import slices, texts_of, written
from precis.llm.kernels import BYTE, gram_hashes, inverse_powers, mix, powers, prefix_sums, sliding_max, sliding_min, substring_hash

__all__ = ["anchors_of", "suffix_sort", "repeated_spans", "marked", "dedup_digests", "dedup_texts"]

GRAM = 40


# ---------------------------------------------------------------- anchors
def anchors_of(grams: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors in a document whose gram hashes are ``grams``."""
    width = length - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    key = (grams >> np.uint64(32)).astype(np.uint32)
    least = sliding_min(key, width)
    # a place is an anchor if some full window that holds it has its key as the least one
    pad = np.zeros(width - 1, np.uint32)
    return np.flatnonzero(sliding_max(np.concatenate([pad, least, pad]), width) == key)


def _context(n: int, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the bytes that windows holding the gram at ``at`` can reach."""
    return np.maximum(at - (length - GRAM), 0), np.minimum(at + length, n)


def _documents(batches, text, length):
    """Per slice: the batch, its bytes and, per document with a window, (row, start, end, anchors, grams, lo, hi, contexts)."""
    for b in slices(batches, text):
        data, off = texts_of(b.column(b.schema.get_field_index(text)))
        sums = prefix_sums(data)
        grams = gram_hashes(sums, GRAM)
        found = []
        for i in np.flatnonzero(np.diff(off) >= length).tolist():
            s, e = int(off[i]), int(off[i + 1])
            at = anchors_of(grams[s:e - GRAM + 1], length)
            lo, hi = _context(e - s, at, length)
            ctx = mix(substring_hash(sums, s + lo, s + hi) + mix((at - lo).astype(np.uint64)) + (hi - at).astype(np.uint64))
            found.append((i, s, at, grams[s + at], lo, hi, ctx))
        yield b, data, found


def _anchor_rows(src: DataFrame, length: int) -> DataFrame:
    """(row, pos, lo, hi, gram, ctx): anchors with bounds (relative to the document) and digest of their contexts."""
    schema = pa.schema([("row", pa.binary()), ("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
                        ("gram", pa.int64()), ("ctx", pa.int64())])

    def run(batches):
        for b, _, found in _documents(batches, "text", length):
            if found:
                rows = np.concatenate([np.full(len(x[2]), x[0]) for x in found])
                at, gram, lo, hi, ctx = (np.concatenate([x[k] for x in found]) for k in range(2, 7))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *map(pa.array, (at, lo, hi, gram.view(np.int64), ctx.view(np.int64)))],
                                                 schema=schema)

    return src.mapInArrow(run, "row binary, pos bigint, lo bigint, hi bigint, gram bigint, ctx bigint")


def _mixed_contexts(src: DataFrame, length: int, wanted) -> DataFrame:
    """(gram, ctx, left, bytes) of the anchors whose gram passes the fixed-size filter ``wanted``."""
    schema = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        bits = wanted.value
        seen: set[tuple[int, int]] = set()  # sends fewer copies; the rest are dropped after the shuffle
        for _, data, found in _documents(batches, "text", length):
            out = [[], [], [], []]
            if len(seen) > SEEN:
                seen.clear()
            for _, s, *columns in found:
                hit = _passes(bits, columns[1])
                at, gram, lo, hi, ctx = (x[hit] for x in columns)
                for g, c, x, y, p in zip(gram.view(np.int64).tolist(), ctx.view(np.int64).tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
                    if (g, c) not in seen:
                        seen.add((g, c))
                        for column, v in zip(out, (g, c, p - x, data[s + x:s + y].tobytes()), strict=True):
                            column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return src.mapInArrow(run, "gram bigint, ctx bigint, left int, bytes binary")


#: Contexts that a task remembers to have sent.
SEEN = 500_000
#: Bits of the filter that tells mixed grams; fixed, whatever the corpus: it only saves work.
FILTER_BITS = 1 << 26


def _places(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = mix(gram)
    return a & np.uint64(FILTER_BITS - 1), (a >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


def _passes(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    ok = np.ones(len(gram), bool)
    for p in _places(gram):
        ok &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def _filter(mixed: DataFrame) -> np.ndarray:
    """The filter of all mixed grams as bytes, put together from words that Spark has or-ed."""
    def run(batches):
        for b in batches:
            p = np.concatenate(_places(b.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["w", "x"])

    words = mixed.mapInArrow(run, "w bigint, x bigint").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return out.view(np.uint8)


# ---------------------------------------------------------------- suffix sort
class _Suffixes:
    """Suffixes ``data[start:start+size]`` that are compared by prefix hashes.

    ``data`` is made of strings; suffix i starts ``inside[i]`` bytes into its own.  Powers count from the start of a
    string, so the sums are the only array of eight bytes per byte."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, inside: np.ndarray | None = None):
        self.data, self.start, self.size = data, start, size
        self.inside = np.zeros(len(start), np.int64) if inside is None else inside
        first = np.sort(start - self.inside)
        length = np.diff(np.concatenate([first, [len(data)]]))
        longest = int(length.max()) if len(length) else 0
        up, self.inverse = powers(longest + 1), inverse_powers(longest + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for i in range(0, len(first), 1000):
            j = min(i + 1000, len(first))
            lo, hi = int(first[i]), int(first[j]) if j < len(first) else len(data)
            at = np.arange(lo, hi) - np.repeat(first[i:j], length[i:j])
            np.multiply(BYTE[data[lo:hi]], up[at], out=self.sums[lo + 1:hi + 1])
        np.cumsum(self.sums, out=self.sums)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a[i], b[i]: binary search over hash comparisons."""
        x, y = self.start[a], self.start[b]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        sum_x, sum_y, inv_x, inv_y = self.sums[x], self.sums[y], self.inverse[self.inside[a]], self.inverse[self.inside[b]]
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.sums[x + mid] - sum_x) * inv_x == (self.sums[y + mid] - sum_y) * inv_y
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo

    def verified(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        """``common`` with hash collisions corrected by comparing the bytes."""
        out = common.copy()
        for i, (p, q, n) in enumerate(zip(self.start[a].tolist(), self.start[b].tolist(), common.tolist(), strict=True)):
            x, y = self.data[p:p + n], self.data[q:q + n]
            if x.tobytes() != y.tobytes():
                out[i] = int((x != y).argmax())
        return out

    def keys(self) -> np.ndarray:
        """Per suffix a fixed-width string that sorts as the suffix does: its bytes, zeros, and its size, so that a
        suffix sorts before its extensions."""
        width = int(self.size.max()) if len(self.size) else 0
        out = np.zeros((len(self.size), width + 4), np.uint8)
        out[:, width:] = self.size.astype(">u4").view(np.uint8).reshape(-1, 4)
        for i in range(0, len(out), 256):  # bounds the index
            at = np.arange(width)
            n = self.size[i:i + 256, None]
            part = self.data[np.minimum(self.start[i:i + 256, None] + at, len(self.data) - 1)] if len(self.data) else 0
            out[i:i + 256, :width] = np.where(at < n, part, 0)
        return out.view(f"S{width + 4}").ravel()


def suffix_sort(s: _Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within their groups (``group`` ascending); equal suffixes keep their order."""
    order = np.argsort(s.keys(), kind="stable")
    return order[np.argsort(group[order], kind="stable")]


def _windows_twice(right: np.ndarray, left: np.ndarray, r_order, l_order, length: int, lefts: np.ndarray, rights: np.ndarray):
    """Which windows around the anchors of one gram occur twice: arrays (member, first o, last o).

    ``right[i]`` is the common extension of the i-th and (i-1)-th suffix in ``r_order`` (from the anchor on),
    ``left`` the same to the left.  A window that starts o bytes before the anchor is fixed by o bytes to the left
    and length - o to the right; who agrees on both is in one class.  Classes change only at the extensions found,
    so one look per distinct extension is enough.
    """
    m = len(r_order)
    r_place, l_place = np.empty(m, np.int64), np.empty(m, np.int64)
    r_place[r_order], l_place[l_order] = np.arange(m), np.arange(m)
    top = length - GRAM
    steps = np.unique(np.clip(np.concatenate([length - right[1:], left[1:] + 1, length - rights, lefts + 1, [0, top + 1]]), 0, top + 1))
    twice = np.zeros((len(steps) + 1, m), bool)  # by step: the windows from steps[k] to steps[k + 1] - 1; framed by False
    kind = np.int32 if (m + 1) ** 2 < 2**31 else np.int64
    some = max(1, CELLS // m)
    for k in range(0, len(steps) - 1, some):
        a = steps[k:min(k + some, len(steps) - 1), None]
        out_of_reach = (lefts < a) | (rights < length - a)
        pair = np.cumsum(right < length - a, axis=1, dtype=kind)[:, r_place] * kind(m + 1) + np.cumsum(left < a, axis=1, dtype=kind)[:, l_place]
        pair = np.where(out_of_reach, -1 - np.arange(m, dtype=kind), pair)  # like nobody else
        order = np.argsort(pair, axis=1)
        pair = np.take_along_axis(pair, order, axis=1)
        same = np.zeros((len(a), m + 1), bool)
        same[:, 1:-1] = pair[:, 1:] == pair[:, :-1]
        np.put_along_axis(twice[k + 1:k + 1 + len(a)], order, same[:, 1:] | same[:, :-1], axis=1)
    begins = np.argwhere((twice[1:] & ~twice[:-1]).T)
    ends = np.argwhere((twice & ~np.concatenate([twice[1:], np.zeros((1, m), bool)]))[1:].T)
    return begins[:, 0], steps[begins[:, 1]], steps[ends[:, 1] + 1] - 1


#: Steps times members that one numpy pass handles at once.
CELLS = 1 << 17

#: Groups up to this size are compared pair by pair, all of them in one pass.
PAIRS = 8


def repeated_spans(gram: np.ndarray, left: np.ndarray, blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts sorted by gram: arrays (index, begin, end) of bytes, relative to the anchor, in windows that
    occur in another context of the same gram."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    end = np.cumsum([len(x) for x in blobs])
    start = end - np.array([len(x) for x in blobs], np.int64)
    lefts = left.astype(np.int64)
    rights = end - start - lefts
    group = np.searchsorted(np.unique(gram), gram)
    count = np.bincount(group)[group] if len(group) else group

    def ordered(s):
        order = suffix_sort(s, group)
        common = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        a, b = order[inner - 1], order[inner]
        common[inner] = s.verified(a, b, s.common(a, b))
        return order, common

    r_order, right = ordered(_Suffixes(data, start + lefts, rights, lefts))
    backward = _Suffixes(data[::-1], len(data) - (start + lefts), lefts, rights)
    top, out = length - GRAM, []

    # small groups: all pairs, by their distance d in the order to the right
    at = np.flatnonzero((count <= PAIRS) & (right >= 0))
    least = right[at]
    for d in range(1, PAIRS):
        x, y = r_order[at - d], r_order[at]
        near = length - least <= top
        w = np.zeros(len(at), np.int64)
        w[near] = backward.verified(x[near], y[near], backward.common(x[near], y[near]))
        a, b = np.maximum(length - least, 0), np.minimum(w, top)
        ok = near & (a <= b)
        out += [(x[ok], a[ok], b[ok]), (y[ok], a[ok], b[ok])]
        far = np.flatnonzero(at - d > 0)
        far = far[group[at[far] - d - 1] == group[at[far]]]
        least = np.minimum(least[far], right[at[far] - d])
        at = at[far]
        if not len(at):
            break

    if (count > PAIRS).any():
        l_order, l_common = ordered(backward)
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if j - i > PAIRS:
                k, a, b = _windows_twice(right[i:j], l_common[i:j], r_order[i:j] - i, l_order[i:j] - i, length, lefts[i:j], rights[i:j])
                out.append((i + k, a, b))
    who, a, b = (np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in range(3))
    if not len(who):
        return who, a, b
    # unite what windows of one member have in common: windows a..b cover the bytes from -b to length - a
    begin, stop = -b, length - a
    order = np.lexsort((begin, who))
    who, begin, stop = who[order], begin[order], stop[order]
    wide = 4 * length
    reach = np.maximum.accumulate(stop + who * wide)
    new = np.ones(len(who), bool)
    new[1:] = begin[1:] + who[1:] * wide > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(who)]]) - 1
    return who[first], begin[first], (reach - who * wide)[last]


#: Contexts that are sorted together, unless one gram has more.
TOGETHER = 1500


def _resolved(contexts: DataFrame, length: int, key: str = "gram") -> DataFrame:
    """(gram, ctx, begin, end) of repeated bytes relative to the anchor, for mixed contexts partitioned by ``key``: a gram,
    or part of one."""
    schema = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        def solve(rows):
            t = pa.Table.from_batches(rows)
            group, gram, ctx = (t.column(i).to_numpy() for i in (0, 4, 1))
            at, begin, end = repeated_spans(group, t.column("left").to_numpy(), t.column("bytes").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[at], ctx[at], begin, end)], schema=schema)

        rows: list[pa.RecordBatch] = []  # whole groups, and the last one as far as it has come
        last, size = None, 0
        for b in batches:
            g = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            begin = 0
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if g[i] != last and size >= TOGETHER:
                    yield solve([*rows, b.slice(begin, i - begin)])
                    rows, size, begin = [], 0, i
                last, size = g[i], size + j - i
            if begin < len(g):
                rows.append(b.slice(begin))
        if rows:
            yield solve(rows)

    grouped = contexts.select(F.col(key).alias("group"), "ctx", "left", "bytes", "gram")
    return grouped.sortWithinPartitions("group", "ctx").mapInArrow(run, "gram bigint, ctx bigint, begin bigint, end bigint")


#: Contexts of one gram that a task sorts; those of a gram with more are dealt out by what they share.
WIDE = 30_000


def _halves(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts in each half of their range [a, b] of window offsets that holds one of their windows, with two hashes:
    ``key`` of the bytes that all windows of the half share, ``whole`` of those that any of them holds."""
    names = ["key", "gram", "ctx", "left", "bytes", "a", "b", "whole", "begin", "end"]

    def run(batches):
        for x in slices(batches, "bytes"):
            data, off = texts_of(x.column(3))
            sums = prefix_sums(data)
            lefts, low, high = (x.column(i).to_numpy().astype(np.int64) for i in (2, 4, 5))
            rights, middle = np.diff(off) - lefts, (low + high) >> 1
            for a, b in ((low, middle), (middle + 1, high)):
                at = np.flatnonzero(np.maximum(a, length - rights) <= np.minimum(b, lefts))
                if not len(at):
                    continue
                a, b, place = a[at], b[at], (off[:-1] + lefts)[at]
                begin, end = -np.minimum(b, lefts[at]), np.minimum(length - a, rights[at])
                tell = lambda p, q: mix(((p << 32) + q).astype(np.uint64))
                key = mix(substring_hash(sums, place - a, place + length - b) + tell(a, b))
                whole = mix(substring_hash(sums, place + begin, place + end) + tell(-begin, end))
                part = x.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *part.columns[:4], pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                                                  pa.array(whole.view(np.int64)), pa.array(begin), pa.array(end)], names=names)

    return contexts.select("gram", "ctx", "left", "bytes", "a", "b").mapInArrow(
        run, "key bigint, gram bigint, ctx bigint, left int, bytes binary, a int, b int, whole bigint, begin bigint, end bigint")


def _dealt(contexts: DataFrame, length: int) -> DataFrame:
    """What :func:`_resolved` gives, for grams with very many contexts, so that no task holds a gram.

    Two contexts with the same window at offset o in [a, b] share the a bytes before the anchor and the length - b from
    it on, so contexts are dealt by these.  A group that is still too large has its range halved.  Members of it that agree on
    all bytes of the range need no further look, and one of them goes on for the rest; at a single offset nobody is left."""
    sc = contexts.sparkSession.sparkContext
    found = []
    contexts = contexts.withColumn("a", F.lit(0)).withColumn("b", F.lit(length - GRAM))
    while True:
        rows = _halves(contexts, length)
        shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
        wide = F.broadcast(shared.where(F.col("n") > WIDE).select("key"))  # one for more than WIDE contexts
        rows = _passing(rows, sc.broadcast(_filter(shared.select("key"))), "key")
        found.append(_resolved(rows.join(wide, "key", "left_anti").repartition("key"), length, "key"))
        if shared.where(F.col("n") > WIDE).isEmpty():
            break
        large = rows.join(wide, "key", "left_semi")
        twice = large.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found.append(large.join(twice, ["key", "whole"], "left_semi").select("gram", "ctx", "begin", "end"))
        contexts = written(large.dropDuplicates(["key", "whole"]), "contexts")
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- operator
def _row_key(text: str, doc_id: str):
    """128 bits of a row's id and text: rows that agree on both have the same spans."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.col(doc_id).cast("string"), F.col(text).cast("string"))))


def marked(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, spans): the repeated byte spans [begin, end) of rows that have any; ``row`` is the key of the row."""
    sc = docs.sparkSession.sparkContext
    src = docs.select(_row_key(text, doc_id).alias("row"), F.col(text).cast("string").alias("text"))
    anchors = written(_anchor_rows(src, length), "anchors")
    counts = anchors.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"))
    per_gram = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    twice = written(counts.where("n > 1").select("gram", "ctx"), "contexts")
    mixed = written(per_gram.where("kinds > 1").select("gram", "kinds"), "grams")
    wanted = sc.broadcast(_filter(mixed.select("gram")))
    sent = _mixed_contexts(src, length, wanted)
    wide = written(mixed.where(F.col("kinds") > WIDE).select("gram"), "grams")  # one for more than WIDE contexts
    # one shuffle: equal contexts meet where their gram is sorted; a gram that the filter let pass by chance has one
    # context and gives nothing
    if wide.isEmpty():
        found = _resolved(sent.repartition("gram").dropDuplicates(["gram", "ctx"]), length)
    else:
        sent = written(sent, "sent")  # read twice, made once
        rest = sent.join(F.broadcast(wide), "gram", "left_anti")
        many = written(sent.join(F.broadcast(wide), "gram", "left_semi").dropDuplicates(["gram", "ctx"]), "contexts")
        found = _resolved(rest.repartition("gram").dropDuplicates(["gram", "ctx"]), length).unionByName(_dealt(many, length))
    # windows of mixed contexts, and (without an extent) whole contexts that occur twice
    no = F.lit(None).cast("bigint")
    marks = written(found.unionByName(twice.select("gram", "ctx", no.alias("begin"), no.alias("end"))), "spans")
    near = _passing(anchors, sc.broadcast(_filter(marks.select("gram").distinct())), "gram")
    hit = near.join(marks, ["gram", "ctx"]).where(F.col("begin").isNotNull() | (F.col("hi") - F.col("lo") >= length)).select(
        "row", F.coalesce(F.col("pos") + F.col("begin"), F.col("lo").cast("bigint")).alias("begin"),
        F.coalesce(F.col("pos") + F.col("end"), F.col("hi").cast("bigint")).alias("end"))
    return hit.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _passing(rows: DataFrame, wanted, column: str) -> DataFrame:
    """Rows whose ``column`` passes the filter; what passes by chance finds nothing later."""
    at = rows.columns.index(column)

    def run(batches):
        bits = wanted.value
        for b in batches:
            yield b.filter(pa.array(_passes(bits, b.column(at).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for x in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append([*x])
    return out


def _kept(data: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def dedup_digests(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats (whether any byte is removed)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(_row_key(text, doc_id).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = d.join(marked(docs, length, text, doc_id), "row", "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for t, spans in zip(b.column(1), b.column(2), strict=True):
                data = (t.as_py() or "").encode()
                gone = _merged(spans.as_py())
                for column, v in zip(out, (len(data), sum(y - x for x, y in gone), len(gone), hashlib.sha256(_kept(data, gone)).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()),
                                              pa.array([x > 0 for x in out[1]], pa.bool_())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, has_repeats boolean")


def _whole_characters(data: bytes, spans) -> list[list[int]]:
    """Spans cut back to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append([a, b])
    return out


def dedup_texts(docs: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated spans (whole characters) removed from ``text`` and ``n_chars`` counted anew; a row that
    had text and has none left goes."""
    columns = docs.columns
    keyed = docs.withColumn("__row", _row_key(text, doc_id))
    spans = marked(docs, length, text, doc_id).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    both = keyed.join(spans, "__row", "left").drop("__row")
    at = both.columns.index(text)

    def run(batches):
        for b in batches:
            texts, keep = [], []
            for t, s in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                if not s.is_valid:
                    texts.append(t.as_py())
                    keep.append(True)
                    continue
                data = (t.as_py() or "").encode()
                left = _kept(data, _whole_characters(data, _merged(s.as_py()))).decode()
                texts.append(left)
                keep.append(bool(left) or not data)
            arrays = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    out = both.select(*columns, "__spans").mapInArrow(run, schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in columns else out

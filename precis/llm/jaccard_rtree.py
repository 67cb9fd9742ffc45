"""N-gram Jaccard join with a count-vector R-tree (operator 6).

Every text is the set of its k-word shingles.  The shingle space is cut into
``GROUPS`` groups by hash, and a set's *count vector* says how many of its
shingles fall into each group.  Summed coordinate minima of two vectors bound
the overlap of the sets from above, and so do a vector and the coordinate
maxima of an R-tree node: subtrees that cannot reach the threshold are skipped,
surviving pairs are verified on the sets.

No pair over the threshold is lost, at any size:

1. Equal sets are one *class* (aggregated by a digest), so copies never meet.
2. Two sets with Jaccard >= t share one of the first ``n - ceil(t n) + 1``
   shingles of either in any common order.  Frequent shingles come last in that
   order; their frequencies are an estimate, which only affects speed.
3. Shared shingles deal classes into lists; lists with the same leader are
   united.  First every class is verified against its first ``LEADERS``
   leaders, which collapses large groups of near copies into components in
   linear work.  Then, in lists that still hold several components, the R-tree
   finds the remaining pairs across components.  A list with many of them gives
   spanning forests of its components first, whose links unite nearly all of
   them, and is searched again, the last time for every pair that is left.  A
   list beyond ``LIST_ROWS`` classes is dealt out as pairs of blocks, so no task
   holds an unbounded list.

Defined results: null or empty text has no shingles and is a component of its
own; rows without an id link with nothing and have a null component; repeated
rows are members of one class; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import slices, texts_of, written
from precis.llm.graph import components
from precis.llm.kernels import mix, shingle_hashes

__all__ = ["near_classes", "ngram_components", "one_per_component", "CountTree"]

GROUPS = 256
#: Rows (classes) of one list that a task compares; longer lists are split into pairs of blocks.
LIST_ROWS = 20_000
#: Leaders that a class is compared with before the lists are searched.
LEADERS = 4
#: Spanning forests that a list gives, round by round; the last round gives every pair across components.
FORESTS = (1, 8, None)
#: Pairs of a list per class and forest up to which it gives all of them at once.
FEW = 4
#: Shingles that the frequency estimate may call frequent, and from how many sets on.
HOT_SHINGLES, HOT_FROM = 1 << 18, 16
#: Only shingles in the lowest part of the hash order can come early, so only these are counted.
COUNTED = np.uint64(int(0.35 * 2**64))
#: Postings kept by a task before they are dealt to the buckets, and postings of a bucket.
FLUSH, BUCKET = 1 << 20, 500_000
BLOOM_BITS = 1 << 25


def _i64(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), type=pa.int64())


def _digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _vector(shingles: np.ndarray) -> bytes:
    """Counts of the set's shingles by group; a set too large for 16 bits gets the largest count everywhere, which
    bounds nothing but loses nothing."""
    n = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return (n if n.max() < 65536 else np.full(GROUPS, 65535)).astype(np.uint16).tobytes()


def _need(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _sets(batches, k, text_at):
    """(batch, shingle sets) for slices of bounded size."""
    for b in slices(batches, text_at):
        data, off = texts_of(b.column(b.schema.get_field_index(text_at)))
        yield b, shingle_hashes(data, off, k)


# ---------------------------------------------------------------- pass 1: classes, frequent shingles
def _signatures(src: DataFrame, k: int) -> DataFrame:
    """kind 0: a row's class, set size and count vector (id in ``a``); kind 1: a shingle (in ``a``) and its local set count."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0

        def frequent():
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                h, c = h[c > 1], c[c > 1]
                return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int8)), _i64(h), pa.nulls(len(h), pa.int64()),
                                                   pa.array(c.astype(np.int64)), pa.nulls(len(h), pa.binary())], schema=schema)

        for b, sets in _sets(batches, k, "text"):
            cls = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), b.column(0), pa.array(cls, pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([_vector(s) if len(s) else None for s in sets], pa.binary())], schema=schema)
            for c, s in zip(cls, sets, strict=True):
                if c is not None and c not in seen:
                    seen.add(c)
                    low = s[:np.searchsorted(s, COUNTED)]
                    held.append(low)
                    size += len(low)
            if size >= FLUSH:
                yield frequent()
                held, size = [], 0
                seen.clear()
        if (last := frequent()) is not None:
            yield last

    return src.mapInArrow(run, "kind tinyint, a bigint, cls bigint, n bigint, vec binary")


def _frequent(sig: DataFrame):
    """Sorted hashes and estimated counts of the most frequent shingles (bounded by HOT_SHINGLES)."""
    hot = sig.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM)
    rows = hot.orderBy(F.desc("n"), "a").limit(HOT_SHINGLES).toPandas()
    h = rows["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


# ---------------------------------------------------------------- pass 2: postings, lists
def _prefix(s: np.ndarray, percent: int, hot: np.ndarray, hot_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, and their estimated counts (0 unless frequent)."""
    p = len(s) - int(_need(len(s), percent)) + 1
    if not len(hot):
        return s[:p], np.zeros(p, np.int64)
    # frequent shingles of a set are few: look at as many low ones as it takes to fill the prefix
    low = s[:np.searchsorted(s, COUNTED)]
    at = np.minimum(np.searchsorted(hot, low), len(hot) - 1)
    is_hot = hot[at] == low
    first = np.concatenate([low[~is_hot], s[len(low):]])[:p]
    if len(first) == p:
        return first, np.zeros(p, np.int64)
    h, n = low[is_hot], hot_n[at[is_hot]]
    order = np.lexsort((h, n))[:p - len(first)]
    return np.concatenate([first, h[order]]), np.concatenate([np.zeros(len(first), np.int64), n[order]])


def _postings(src: DataFrame, k: int, percent: int, buckets: int, hot_b) -> DataFrame:
    """Prefix shingles, dealt to buckets by hash: one row per bucket and flush, columns packed as binary."""
    schema = pa.schema([("bucket", pa.int32()), ("tok", pa.binary()), ("cls", pa.binary())])

    def run(batches):
        hot, hot_n = hot_b.value
        seen: set[int] = set()
        held, size = [], 0

        def dealt():
            tok, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(tok) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            tok, cls, bucket = tok[order], cls[order], bucket[order]
            names, at = np.unique(bucket, return_index=True)
            cut = [*at.tolist(), len(tok)]
            pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pick(tok), pick(cls)], schema=schema)

        for _, sets in _sets(batches, k, "text"):
            for s in sets:
                if not len(s) or (c := _digest(s)) in seen:
                    continue
                seen.add(c)
                tok, df = _prefix(s, percent, hot, hot_n)
                if (wide := df > LIST_ROWS).any():  # a list too long for a task becomes pairs of blocks
                    more = []
                    for t, d in zip(tok[wide], df[wide].tolist(), strict=True):
                        blocks = -(-d // LIST_ROWS) + 1
                        own = c % blocks
                        i = np.minimum(own, np.arange(blocks)).astype(np.uint64)
                        j = np.maximum(own, np.arange(blocks)).astype(np.uint64)
                        more.append(mix(t + mix(i * np.uint64(blocks) + j + np.uint64(1))))
                    tok = np.concatenate([tok[~wide], *more])
                held.append((tok, np.full(len(tok), c, np.int64)))
                size += len(tok)
            if size >= FLUSH:
                yield dealt()
                held, size = [], 0
                seen.clear()
        if held:
            yield dealt()

    return src.mapInArrow(run, "bucket int, tok binary, cls binary")


def _lists(postings: DataFrame) -> DataFrame:
    """(leader, cls) for every class of every list with two classes or more, once per bucket; ``rank`` orders leaders.

    A list's leader is its class with the least rank, so lists of one group of near copies mostly agree on it; lists
    with the same leader are united, and classes that share a shingle still meet."""
    schema = pa.schema([("leader", pa.int64()), ("cls", pa.int64()), ("rank", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        tok, cls = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("tok", np.uint64), ("cls", np.int64)))
        rank = mix(cls.view(np.uint64))
        order = np.lexsort((rank, tok))
        tok, cls, rank = tok[order], cls[order], rank[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
        tok, cls, rank = tok[new], cls[new], rank[new]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        length = np.diff(np.concatenate([start, [len(tok)]]))
        many = np.repeat(length > 1, length)
        lead = np.repeat(start, length)[many]
        pairs = np.unique(np.stack([cls[lead], cls[many], (rank[lead] >> np.uint64(1)).view(np.int64)], axis=1), axis=0)
        return pa.table([_i64(pairs[:, i]) for i in range(3)], schema=schema)

    return postings.groupBy("bucket").applyInArrow(run, "leader bigint, cls bigint, rank bigint").distinct()


# ---------------------------------------------------------------- sets of the classes in lists
def _bits(key) -> F.Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOOM_BITS)) for i in range(3)])


def _bloom(keys: DataFrame, key: str):
    """Bloom filter of fixed size as words: it only saves work, whatever passes is joined later."""
    bit = keys.select(F.explode(_bits(F.col(key))).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("x")).toPandas()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64)
    return out


def _class_sets(src: DataFrame, k: int, bloom_b) -> DataFrame:
    """(id, cls, items): sorted shingles of the rows whose id passes the filter."""
    schema = pa.schema([("id", pa.int64()), ("cls", pa.int64()), ("items", pa.binary())])
    src = src.withColumn("bits", _bits(F.col("id")))

    def run(batches):
        words = bloom_b.value
        for b in batches:
            bits = b.column(2).flatten().to_numpy().reshape(-1, 3)
            hit = ((words[bits >> 6] >> (bits & 63)) & 1).all(axis=1)
            if not hit.any():
                continue
            for part, sets in _sets([b.filter(pa.array(hit))], k, "text"):
                some = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(some, pa.int64())), pa.array([_digest(sets[i]) for i in some], pa.int64()),
                    pa.array([sets[i].tobytes() for i in some], pa.binary())], schema=schema)

    return src.mapInArrow(run, "id bigint, cls bigint, items binary")


def _sized(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with representatives' ids and sizes, as far as the sizes allow a link."""
    one = classes.select(F.col("cls").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"))
    two = classes.select(F.col("cls").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    return pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of sized pairs those (a, b, ra, rb) whose count vectors allow a link."""
    va, vb = (classes.select(F.col("cls").alias(x), F.col("vec").alias(f"v{x}")) for x in "ab")
    both = pairs.join(va, "a").join(vb, "b").select("a", "b", "ra", "rb", "na", "nb", "va", "vb")

    def run(batches):
        for b in batches:
            if b.num_rows:
                va, vb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, GROUPS) for i in (6, 7))
                size = b.column(4).to_numpy() + b.column(5).to_numpy()
                bound = np.minimum(va, vb).sum(axis=1, dtype=np.int64)
                yield b.select([0, 1, 2, 3]).filter(pa.array(bound * (100 + percent) >= percent * size))

    return both.mapInArrow(run, "a bigint, b bigint, ra bigint, rb bigint")


def _verified(src: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets reach the threshold, by exact intersection.  The sets of the
    representatives that occur in ``pairs`` are cut from the texts once more, which is cheaper than keeping all."""
    ids = pairs.select(F.col("ra").alias("id")).distinct().unionByName(pairs.select(F.col("rb").alias("id")).distinct()).distinct()
    bloom = src.sparkSession.sparkContext.broadcast(_bloom(ids, "id"))
    sets = written(_class_sets(src, k, bloom), "sets")
    one = sets.select(F.col("cls").alias("a"), F.col("id").alias("ra"), F.col("items").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("id").alias("rb"), F.col("items").alias("y"))
    both = pairs.join(one, ["a", "ra"]).join(two, ["b", "rb"]).select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


# ---------------------------------------------------------------- R-tree
class CountTree:
    """R-tree over count vectors, bulk-loaded: points sorted by size, then by their widest coordinate, ``FAN`` to a
    node.  A node keeps coordinate maxima and its range of sizes."""

    FAN = 16

    def __init__(self, vec: np.ndarray, size: np.ndarray):
        wide = vec[:, int(vec.var(axis=0).argmax())] if len(vec) else np.zeros(0)
        slab = np.empty(len(vec), np.int64)
        slab[np.argsort(size, kind="stable")] = np.arange(len(vec)) // (self.FAN * self.FAN)
        self.order = np.lexsort((wide, slab))
        self.levels = [(vec[self.order], size[self.order], size[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, lo, hi = self.levels[-1]
            cut = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def pairs(self, percent: int, chunk: int = 1 << 14):
        """(i, j), i before j in ``order``, whose bound reaches the threshold: overlap (100 + t) >= t (n_i + n_j)."""
        vec, size, _ = self.levels[0]
        for q0 in range(0, len(vec), 512):
            q = np.arange(q0, min(q0 + 512, len(vec)))
            node = np.zeros(len(q), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                top, lo, hi = self.levels[level]
                if level < len(self.levels) - 1:  # children of the nodes that are left
                    q = np.repeat(q, self.FAN)
                    node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                    ok = node < len(top)
                    q, node = q[ok], node[ok]
                ok = ((node + 1) * self.FAN ** level > q + 1) & (100 * hi[node] >= percent * size[q]) & (100 * size[q] >= percent * lo[node])
                q, node = q[ok], node[ok]
                keep = np.empty(len(q), bool)
                for c in range(0, len(q), chunk):
                    s = slice(c, c + chunk)
                    bound = np.minimum(vec[q[s]], top[node[s]]).sum(axis=1, dtype=np.int64)
                    keep[s] = bound * (100 + percent) >= percent * (size[q[s]] + lo[node[s]])
                q, node = q[keep], node[keep]
            yield self.order[q], self.order[node]


def spanning_forest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Which edges (best first, ends numbered below ``nodes``) are in the maximum spanning forest (Boruvka's rounds)."""
    label, live = np.arange(nodes), np.flatnonzero(u != v)
    taken = np.zeros(len(u), bool)
    while len(live):
        a, b = label[u[live]], label[v[live]]
        best = np.full(nodes, len(u))
        for end in (a, b):
            first = np.full(nodes, len(u))
            first[end[::-1]] = live[::-1]  # the last one written is the best
            best = np.minimum(best, first)
        top = np.flatnonzero(best < len(u))
        taken[best[top]] = True
        up = np.arange(nodes)
        x, y = label[u[best[top]]], label[v[best[top]]]
        up[top] = np.where(x == top, y, x)
        both = (up[up] == np.arange(nodes)) & (up > np.arange(nodes))  # two that chose the same edge: the smaller is the root
        up[both] = np.flatnonzero(both)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
        live = live[label[u[live]] != label[v[live]]]
    return taken


def _forests(i, j, score, node, forests: int):
    """Of the edges (i, j) those in ``forests`` maximum spanning forests of the components ``node``, none in two."""
    order = np.lexsort((j, i, -score))
    i, j, score = i[order], j[order], score[order]
    u, v, nodes = node[i], node[j], int(node.max()) + 1
    keep, rest = np.zeros(len(i), bool), np.arange(len(i))
    for _ in range(forests):
        taken = spanning_forest(u[rest], v[rest], nodes)
        keep[rest[taken]] = True
        rest = rest[~taken]
        if not len(rest):
            break
    return i[keep], j[keep], score[keep]


def _across(lists: DataFrame, percent: int, forests: int | None = None) -> DataFrame:
    """(a, b, cut): pairs of classes in one list (``key``) but different components that the count vectors allow.  A list
    with more than ``FEW * forests`` pairs per class gives, of those, maximum spanning forests by the bound, and says so
    in ``cut``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cut", pa.bool_())])

    def run(batches):
        found: dict[tuple[int, int], bool] = {}

        def out():
            rows = np.array(list(found), np.int64).reshape(-1, 2)
            cut = pa.array(list(found.values()), pa.bool_())
            found.clear()
            return pa.RecordBatch.from_arrays([_i64(rows[:, 0]), _i64(rows[:, 1]), cut], schema=schema)

        def one(rows):
            cls, comp, n, vec = (np.concatenate([r[i] for r in rows]) for i in range(4))
            node = np.unique(comp, return_inverse=True)[1]
            most = FEW * (forests or 0) * len(cls)
            held, cut = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], False
            for i, j in CountTree(vec, n).pairs(percent):
                far = node[i] != node[j]
                i, j = i[far], j[far]
                if forests is not None:
                    score = np.concatenate([np.minimum(vec[i[c:c + 4096]], vec[j[c:c + 4096]]).sum(axis=1, dtype=np.int64)
                                            for c in range(0, len(i), 4096)] or [np.zeros(0)]) / np.maximum(n[i] + n[j], 1)
                    held = [np.concatenate(x) for x in zip(held, (i, j, score), strict=True)]
                    if len(held[0]) <= most:
                        continue
                    held, cut = list(_forests(*held, node, forests)), True
                else:
                    yield from told(cls[i], cls[j], False)
            if cut:
                held = _forests(*held, node, forests)
            yield from told(cls[held[0]], cls[held[1]], cut)

        def told(a, b, cut):
            for pair in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
                found[pair] = cut or found.get(pair, False)
            if len(found) > 100_000:
                yield out()

        rows, current = [], None
        for b in batches:
            key, cls, comp, n = (b.column(i).to_numpy() for i in range(4))
            vec = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(-1, GROUPS)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            for i, j in zip(cut, [*cut[1:], len(key)], strict=True):
                if key[i] != current and rows:
                    yield from one(rows)
                    rows = []
                current = key[i]
                rows.append([x[i:j] for x in (cls, comp, n, vec)])
        if rows:
            yield from one(rows)
        if found:
            yield out()

    ordered = lists.select("key", "cls", "comp", "n", "vec").repartition("key").sortWithinPartitions("key", "cls")
    return ordered.mapInArrow(run, "a bigint, b bigint, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut"))


def _mixed_lists(lists: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cls, comp, n, vec) of lists that hold several components; beyond LIST_ROWS as pairs of blocks."""
    placed = lists.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "leader", "cls", F.coalesce("component", "cls").alias("comp"))
    # the smallest class of a component carries the component's own name, as coalesce() gives
    several = placed.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where(
        "lo <> hi").select("leader", F.ceil(F.col("size") / LIST_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = placed.join(several, "leader").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("leader")).otherwise(F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select(key.alias("key"), "cls", "comp").join(classes.select("cls", "n", "vec"), "cls")


# ---------------------------------------------------------------- operator
def near_classes(docs: DataFrame, k: int, percent: int, text: str = "text", doc_id: str = "doc_id"):
    """(rows, classes): rows (id, cls, n) of every row with an id; classes (cls, n, rep, component_id), with ``rep``
    the smallest id of the class and ``component_id`` the smallest id reachable by links."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())
    sig = written(_signatures(src, k), "signatures")
    rows = sig.where("kind = 0").select(F.col("a").alias("id"), "cls", "n")
    classes = written(sig.where("kind = 0 and cls is not null").groupBy("cls").agg(
        F.first("n").alias("n"), F.min("a").alias("rep"), F.first("vec").alias("vec")), "classes")
    hot = sc.broadcast(_frequent(sig))
    load = classes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100.0) + 1"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(load) // BUCKET + 1)
    lists = written(_lists(_postings(src, k, percent, buckets, hot)), "lists")
    # every class against its LEADERS first leaders: collapses groups of near copies
    first = _sized(lists.where("leader <> cls").select(F.col("leader").alias("a"), F.col("cls").alias("b"), "rank"), classes, percent)
    by = F.slice(F.array_sort(F.collect_set(F.struct("rank", "a", "ra", "na"))), 1, LEADERS)
    first = first.groupBy("b", "rb", "nb").agg(by.alias("by")).select("b", "rb", "nb", F.explode("by").alias("by")).select("b", "rb", "nb", "by.a", "by.ra", "by.na")
    led = written(_possible(first, classes, percent), "pairs")
    links = written(_verified(src, led, k, percent), "links")

    known = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    reps = classes.select("cls", "rep")
    comp = components(links)
    for forests in FORESTS:
        found = written(_across(_mixed_lists(lists, comp, classes), percent, forests), "across")
        new = found.select("a", "b").join(known, ["a", "b"], "left_anti").join(
            reps.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(
            reps.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b")
        new = written(new, "pairs")
        links = links.unionByName(written(_verified(src, new, k, percent), "links"))
        comp = components(links)
        if found.where("cut").isEmpty():  # no list kept a pair back
            break
        known = known.unionByName(new.select("a", "b"))
    named = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "rep", F.coalesce("component", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return rows, named.join(least, "comp").select("cls", "n", "rep", "component_id")


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows, classes = near_classes(docs, k, percent, text, doc_id)
    found = rows.join(classes.select("cls", "component_id"), "cls", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    bare = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return found.unionByName(bare)


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component (the smallest id; of rows that share id and component, one) and every
    row without shingles or id."""
    rows, classes = near_classes(docs, k, percent, text, doc_id)
    own = rows.where(F.col("cls").isNotNull()).join(classes.select("cls", "component_id"), "cls").where("id = component_id")
    keep = written(own.select("id").distinct().unionByName(rows.where(F.col("cls").isNull()).select("id").distinct()).distinct(), "kept")
    with_id = docs.where(F.col(doc_id).isNotNull())
    kept = with_id.join(keep.select(F.col("id").alias(doc_id)), doc_id, "left_semi")
    return kept.dropDuplicates([doc_id, text]).select(docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))

"""Document fingerprints: Merkle trees over sections, paragraphs and leaves (operator 4).

Leaves are stretches of about ``1 << LEAF_BITS`` bytes whose ends depend on
the bytes around them only (and on line ends), so an edit changes the leaves it
touches and no others.  Paragraphs are lines, sections are runs of paragraphs
that end at an empty line or at a paragraph chosen by its digest.  A node's
digest covers its children's; the root covers the whole text.

Fingerprint: ``<root>|<section>:<paragraph>=<leaf><leaf>...,<paragraph>=...|...``
in hex.  Equal roots are equal texts; comparing digests from the root down
finds the differing branches (:func:`differences`); :func:`likeness` is the
share of leaves that two fingerprints have in common.

Defined results: null text is empty; an empty text has a root and no leaves,
is like another empty text (1) and like nothing else (0); rows with equal ids
follow each other by text; null ids come first; an empty table gives an empty
result; a single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import texts_of
from precis.llm.kernels import gram_hashes, mix, prefix_sums, substring_hash

__all__ = ["fingerprints", "likeness", "differences", "edited_fingerprints"]

GRAM, LEAF_BITS, LEAF_MAX = 8, 4, 64
#: One paragraph in 1 << SECTION_BITS ends a section.
SECTION_BITS = 3


class Tree:
    """A text's tree: the fingerprint and its leaves (sorted 32-bit digests)."""

    __slots__ = ("text", "leaves")

    def __init__(self, text: str, leaves: np.ndarray):
        self.text, self.leaves = text, leaves


def _trees(data: np.ndarray, off: np.ndarray) -> list[Tree]:
    """Trees of the documents in ``data``."""
    sums = prefix_sums(data)
    cut = np.zeros(len(data) + 1, bool)
    grams = gram_hashes(sums, GRAM)
    cut[GRAM:GRAM + len(grams)] = grams & np.uint64((1 << LEAF_BITS) - 1) == 0
    lines = np.zeros(len(data) + 1, bool)
    lines[1:] = data == 10
    # a gram that reaches back over the start of its document does not count
    begin = np.repeat(off[:-1], np.diff(off))
    cut[:-1] &= np.arange(len(data)) - begin >= GRAM
    cut |= lines
    cut[off] = True
    ends = np.flatnonzero(cut)
    gap = np.diff(ends)
    if (gap > LEAF_MAX).any():  # stretches without an end of their own
        more = [np.arange(a + LEAF_MAX, b, LEAF_MAX) for a, b in zip(ends[:-1][gap > LEAF_MAX].tolist(), ends[1:][gap > LEAF_MAX].tolist(), strict=True)]
        ends = np.sort(np.concatenate([ends, *more]))
    leaf = substring_hash(sums, ends[:-1], ends[1:]) if len(ends) > 1 else np.zeros(0, np.uint64)
    short = (leaf >> np.uint64(32)).astype(np.uint32)
    # paragraphs: leaves up to one that ends with a line feed, or the document's last
    of = np.searchsorted(ends, off)
    last = lines[ends[1:]] | np.isin(ends[1:], off[1:]) if len(leaf) else np.zeros(0, bool)
    para_end = np.flatnonzero(last) + 1
    para_start = np.concatenate([[0], para_end[:-1]]) if len(para_end) else np.zeros(0, np.int64)
    leaf_sums = prefix_sums(leaf)
    para = substring_hash(leaf_sums, para_start, para_end) if len(para_end) else np.zeros(0, np.uint64)
    blank = ends[para_end] - ends[para_start] <= 1 if len(para_end) else np.zeros(0, bool)
    closes = (para & np.uint64((1 << SECTION_BITS) - 1) == 0) | blank
    first_para = np.searchsorted(para_start, of) if len(para_end) else np.zeros(len(of), np.int64)
    out = []
    hexes = short.astype(">u4").tobytes().hex()
    names = para.astype(">u8").tobytes().hex()
    starts, stops, shut = para_start.tolist(), para_end.tolist(), closes.tolist()
    for i in range(len(off) - 1):
        a, b = int(first_para[i]), int(first_para[i + 1])
        sections, inside = [], []
        for p in range(a, b):
            inside.append(f"{names[16 * p:16 * p + 16]}={hexes[8 * starts[p]:8 * stops[p]]}")
            if shut[p] or p == b - 1:
                body = ",".join(inside)
                digest = hashlib.blake2b("".join(x[:16] for x in inside).encode(), digest_size=8).hexdigest()
                sections.append(f"{digest}:{body}")
                inside = []
        size = int(off[i + 1] - off[i])
        root = hashlib.blake2b("".join(x[:16] for x in sections).encode() + size.to_bytes(8, "little"), digest_size=16).hexdigest()
        out.append(Tree("|".join([root, *sections]), np.sort(short[of[i]:of[i + 1]])))
    return out


def _trees_of(texts: list[str], limit: int = 1 << 20) -> list[Tree]:
    out, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > limit:
            out += _trees(*texts_of(pa.array(held, pa.string())))
            held, size = [], 0
    return out + (_trees(*texts_of(pa.array(held, pa.string()))) if held else [])


def _parsed(fingerprint: str):
    root, *sections = fingerprint.split("|")
    return root, [(s[:16], [(p[:16], [p[17:][i:i + 8] for i in range(0, len(p) - 17, 8)]) for p in s[17:].split(",")]) for s in sections]


def likeness(a: str, b: str) -> float:
    """Share of leaves in common (Dice over the multisets), from two fingerprints alone."""
    (ra, sa), (rb, sb) = _parsed(a), _parsed(b)
    if ra == rb:
        return 1.0
    x, y = (Counter(leaf for _, ps in s for _, leaves in ps for leaf in leaves) for s in (sa, sb))
    n = x.total() + y.total()
    return 2 * (x & y).total() / n if n else 1.0


def _alike(a: Tree, b: Tree) -> float:
    if a.text[:32] == b.text[:32]:
        return 1.0
    n = len(a.leaves) + len(b.leaves)
    if not n:
        return 1.0
    names, at = np.unique(np.concatenate([a.leaves, b.leaves]), return_inverse=True)
    x = np.bincount(at[:len(a.leaves)], minlength=len(names))
    y = np.bincount(at[len(a.leaves):], minlength=len(names))
    return 2 * int(np.minimum(x, y).sum()) / n


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``b`` whose branch does not occur in ``a``; equal branches are not opened."""
    (ra, sa), (rb, sb) = _parsed(a), _parsed(b)
    if ra == rb:
        return []
    sections = {s for s, _ in sa}
    paragraphs = {p for _, ps in sa for p, _ in ps}
    return [(i, j) for i, (s, ps) in enumerate(sb) if s not in sections for j, (p, _) in enumerate(ps) if p not in paragraphs]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.text for t in _trees_of(b.column(1).to_pylist())], pa.string())],
                                             names=["doc_id", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _with_next(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows dealt to buckets of ascending ids, sorted; the first row of every bucket is also the last (``ahead``) of
    the bucket before it, and the very first row of the last bucket.  Only bounds of buckets reach the driver."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds]), lambda x: x < F.col("doc_id"))) if bounds else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).cast("int")
    src = src.withColumn("bucket", bucket)
    # the first row of a bucket, by (id, text): its id is enough, a tie is settled by the order of rows in the bucket
    firsts = ids.withColumn("bucket", bucket).groupBy("bucket").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f")).orderBy("bucket").collect()
    if not firsts:
        return src.withColumn("ahead", F.lit(0))
    order = [r["bucket"] for r in firsts]
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    known = [r for r in firsts if r["f"]["known"]]
    is_first = F.col("doc_id").isin([r["f"]["doc_id"] for r in known]) if known else F.lit(False)
    if len(known) < len(firsts):
        is_first = is_first | F.col("doc_id").isNull()
    to = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    # equal first ids: the smallest text of them goes ahead
    heads = src.where(is_first).groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("f")).select(
        F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), to[F.col("bucket")].cast("int").alias("bucket"), F.lit(1).alias("ahead"))
    both = src.withColumn("ahead", F.lit(0)).unionByName(heads)
    return both.repartitionById(max(n, len(order)), F.col("bucket")).sortWithinPartitions("bucket", "ahead", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as much of the start of the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def some(rows, after):
        """rows: (id, text) in order, ``after``: the text behind the last."""
        texts = [t for _, t in rows] + [after]
        edited = []
        for t, u in zip(texts, texts[1:]):
            k = len(t) // 4
            edited.append(t[:len(t) - k] + u[:k])
        own, other = _trees_of(texts), _trees_of(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([t.text for t in own[:-1]]),
            pa.array([t.text for t in other]), pa.array([_alike(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([_alike(a, b) for a, b in zip(own, own[1:])], pa.float64())], schema=schema)

    def run(batches):
        rows, size, current = [], 0, None
        for b in batches:
            for i, t, bucket, ahead in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and (ahead or size > 1 << 20):  # the row at hand follows the ones that are held
                    yield some(rows, t)
                    rows, size = [], 0
                if not ahead:
                    rows.append((i, t))
                    size += len(t)
        assert not rows, current

    ordered = _with_next(docs, text, doc_id).select("doc_id", "text", "bucket", "ahead")
    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double")

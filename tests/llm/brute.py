"""Brute-force versions that the operators are held against."""

import re
import string

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(rows, k, percent):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    done = set()
    for i, s in sets.items():
        near = {j for x in s for j in holders[x] if j > i}
        for j in near:
            if (i, j) in done or find(i) == find(j):
                continue
            n = len(s & sets[j])
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeated(rows, length):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept)} by counting every window of ``length`` bytes."""
    from collections import Counter
    from hashlib import blake2b

    def key(b, i):
        return blake2b(b[i:i + length], digest_size=12).digest()

    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(key(b, i) for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[key(b, i)] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out

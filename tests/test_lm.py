"""LM / decoding against plain-Python brute force on the smallest tables."""
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from precis.operators import decode as dc
from precis.operators import lm as lmx
from precis.plans import catalog as C


@pytest.fixture(scope="module")
def parts(spark):
    C._MEMO.clear()
    ids, v, V, lm, ctx = C.lm_parts(spark, SF_SMALL)
    prompts = C._prompts(ids)
    succ = {}
    for r in lm.collect():
        succ.setdefault(r.ctx, []).append((r.token, r.logp, r["count"]))
    return ids, V, lm, prompts, succ


def test_lm_normalised(parts):
    _, V, lm, _, succ = parts
    # seen + unseen mass sums to one per context
    for ctx, rows in list(succ.items())[:50]:
        total = sum(c for _, _, c in rows)
        seen = sum(math.exp(lp) for _, lp, _ in rows)
        unseen = (V - len(rows)) * 1.0 / (total + V)
        assert seen + unseen == pytest.approx(1.0, rel=1e-9)


def _py_beam(start, succ, k, max_len, eos=2):
    ranked = {c: sorted(((t, lp) for t, lp, _ in rows), key=lambda x: (-x[1], x[0]))[:k] for c, rows in succ.items()}
    beams = [(0.0, list(start), False)]
    for _ in range(max_len):
        cands = []
        for score, seq, done in beams:
            nxt = None if done else ranked.get(str(seq[-1]))
            if not nxt:
                cands.append((score, seq, True))
                continue
            for t, lp in nxt:
                cands.append((score + lp, seq + [t], t == eos))
        beams = sorted(cands, key=lambda x: -x[0])[:k]
        if all(d for _, _, d in beams):
            break
    return beams[0]


def test_beam_search_matches_brute_force(spark, parts):
    _, _, lm, prompts, succ = parts
    got = {r.id: r for r in dc.beam_search(prompts, lm, beam_size=3, max_len=12).collect()}
    for p in prompts.collect():
        score, seq, done = _py_beam(p.prompt, succ, 3, 12)
        assert got[p.id].generated == seq[len(p.prompt):]
        assert got[p.id].score == pytest.approx(score, rel=1e-12)
        assert got[p.id].finished == done


def test_greedy_matches_brute_force(spark, parts):
    _, _, lm, prompts, succ = parts
    best = {c: sorted(rows, key=lambda x: (-x[2], x[0]))[0][0] for c, rows in succ.items()}
    got = {r.id: r.generated for r in dc.greedy_decode(prompts, lm, max_len=15).collect()}
    for p in prompts.collect():
        seq, out = list(p.prompt), []
        for _ in range(15):
            n = best.get(str(seq[-1]))
            if n is None or n == 2:
                break
            seq.append(n)
            out.append(n)
        assert got[p.id] == out


def test_length_penalty_and_min_len(spark, parts):
    _, _, lm, prompts, _ = parts
    a = dc.beam_search(prompts, lm, beam_size=2, max_len=6, length_p=2.0, min_len=3).collect()
    assert all(len(r.generated) >= 3 or not r.finished for r in a)
    assert sorted(r.id for r in a) == sorted(r.id for r in prompts.collect())


def test_min_len_loses_no_document(spark):
    lm = spark.createDataFrame([("1", 5, -0.1), ("5", 2, -0.1), ("1", 6, -2.0), ("6", 7, -0.5), ("7", 2, -0.1)], "ctx string, token int, logp double")
    starts = spark.createDataFrame([("a", [1]), ("b", [5]), ("c", [9])], "id string, prompt array<int>")
    got = {r.id: r for r in dc.beam_search(starts, lm, beam_size=2, max_len=30, min_len=30).collect()}
    assert set(got) == {"a", "b", "c"} and all(2 not in r.generated for r in got.values())


# ---------------------------------------------------------------- back-off model
class PyBackoff:
    """The same model from plain counts; every token of the vocabulary is scored after any context."""

    def __init__(self, seqs, vocab, discount=0.75, k=1.0):
        from collections import Counter
        self.c3 = Counter((s[i - 2] if i > 1 else None, s[i - 1], s[i]) for s in seqs for i in range(1, len(s)))
        self.c2, self.c1, self.vocab = Counter(), Counter(), vocab
        for (_, v, w), c in self.c3.items():
            self.c2[v, w] += c
            self.c1[w] += c
        n = sum(self.c1.values())
        self.p1 = {w: (self.c1[w] + k) / (n + k * len(vocab)) for w in vocab}
        self.t2, self.t3 = {}, {}
        for (v, _), c in self.c2.items():
            t, m = self.t2.get(v, (0, 0))
            self.t2[v] = (t + c, m + 1)
        for (u, v, _), c in self.c3.items():
            if u is not None:
                t, m = self.t3.get((u, v), (0, 0))
                self.t3[u, v] = (t + c, m + 1)
        self.d = discount

    def p2(self, v, w):
        t, m = self.t2[v]
        return (self.c2[v, w] - self.d) / t + self.d * m / t * self.p1[w]

    def logp(self, u, v, w):
        r = lambda x: round(math.log(x), 9)
        low = r(self.p1[w])
        if v in self.t2:
            low = r(self.p2(v, w)) if (v, w) in self.c2 else r(self.d * self.t2[v][1] / self.t2[v][0]) + low
        if (u, v) in self.t3:
            t, m = self.t3[u, v]
            if (u, v, w) in self.c3:
                return r((self.c3[u, v, w] - self.d) / t + self.d * m / t * self.p2(v, w))
            return r(self.d * m / t) + low
        return low

    def ranked(self, u, v):
        return sorted(((w, self.logp(u, v, w)) for w in self.vocab), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def backoff(spark):
    C._MEMO.clear()
    ids, m = C.backoff_parts(spark, SF_SMALL)
    seqs = [[1] + r.si + [2] for r in ids.where("split = 'train'").collect()]
    vocab = [r.token_id for r in C.train_vocab(spark, SF_SMALL).collect()]
    return ids, m, PyBackoff(seqs, vocab), C._prompts(ids)


def test_backoff_is_a_distribution(backoff):
    _, _, py, _ = backoff
    for u, v in [*list(py.t3)[:5], (None, 1), (10**6, 10**6)]:
        assert sum(math.exp(py.logp(u, v, w)) for w in py.vocab) == pytest.approx(1.0, rel=0.02)


def test_ranked_equals_whole_vocabulary(backoff):
    _, m, py, _ = backoff
    best, tables = m.ranked(4)
    assert [t for t, _ in best] == [w for w, _ in py.ranked(None, 10**6)[:4]]
    for n, rows in ((2, tables[2].limit(60).collect()), (3, tables[3].limit(120).collect())):
        assert rows
        for r in rows:
            u, v = (r.ctx >> 32, r.ctx & 0xFFFFFFFF) if n == 3 else (10**6, r.ctx)
            want = py.ranked(u, v)[:4]
            assert [c.token for c in r.cand] == [w for w, _ in want], (n, r.ctx)
            assert [c.logp for c in r.cand] == pytest.approx([lp for _, lp in want], abs=1e-9)


def _backoff_beam(py, start, k, max_len, min_len=0, eos=2):
    beams = [(0.0, list(start), False)]
    for _ in range(max_len):
        cands = []
        for score, seq, done in beams:
            if done:
                cands.append((score, seq, True))
                continue
            u, v = (seq[-2] if len(seq) > 1 else None), seq[-1]
            allowed = [x for x in py.ranked(u, v) if len(seq) - len(start) >= min_len or x[0] != eos]
            cands += [(score + lp, seq + [t], t == eos) for t, lp in allowed[:k]]
        beams = sorted(cands, key=lambda x: -x[0])[:k]
        if all(d for _, _, d in beams):
            break
    return beams[0]


def test_backoff_beam_matches_brute_force(spark, backoff):
    _, m, py, prompts = backoff
    extra = spark.createDataFrame([("odd", [999999, 888888]), ("one", [1])], "id string, prompt array<int>")
    starts = prompts.unionByName(extra)
    for min_len in (0, 4):
        got = {r.id: r for r in dc.beam_search(starts, m, beam_size=3, max_len=8, min_len=min_len).collect()}
        for p in starts.collect():
            score, seq, done = _backoff_beam(py, p.prompt, 3, 8, min_len)
            assert got[p.id].generated == seq[len(p.prompt):]
            assert got[p.id].score == pytest.approx(score, rel=1e-9) and got[p.id].finished == done


def test_backoff_greedy_matches_brute_force(spark, backoff):
    _, m, py, prompts = backoff
    got = {r.id: r.generated for r in dc.greedy_decode(prompts, m, max_len=10).collect()}
    for p in prompts.collect():
        _, seq, done = _backoff_beam(py, p.prompt, 1, 10)
        assert got[p.id] == [t for t in seq[len(p.prompt):] if not (done and t == 2)]


def test_shuffled_look_up_gives_the_same(spark, backoff, monkeypatch):
    """Tables too large for a broadcast: the joins shuffle, finished rows included."""
    _, m, _, prompts = backoff
    want = sorted((r.id, r.generated) for r in dc.greedy_decode(prompts, m, max_len=6).collect())
    monkeypatch.setattr(dc, "bounded_broadcast", lambda df: df)
    assert sorted((r.id, r.generated) for r in dc.greedy_decode(prompts, m, max_len=6).collect()) == want

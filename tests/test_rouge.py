import math

import pytest
from pyspark.sql import functions as F

from precis.operators import rouge as rg

GOLD = [  # (reference, candidate, r1 F, r2 F, LCS, rL F) — FIXTURES.md
    ("the cat sat on the mat", "the cat on the mat sat", 1.0, 0.6, 5, 5 / 6),
    ("police killed the gunman", "police kill the gunman", 0.75, 1 / 3, 3, 0.75),
    ("police killed the gunman", "the gunman kill police", 0.75, 1 / 3, 2, 0.5),
]


def test_rouge_gold(spark):
    df = spark.createDataFrame([(i, r, c) for i, (r, c, *_) in enumerate(GOLD)], "i int, ref string, cand string")
    s = rg.rouge_columns(df, "cand", "ref", ("rouge1", "rouge2", "rougeL")).orderBy("i").collect()
    for row, (_, _, f1, f2, _, fl) in zip(s, GOLD):
        assert math.isclose(row.rouge1.fmeasure, f1, rel_tol=1e-9)
        assert math.isclose(row.rouge2.fmeasure, f2, rel_tol=1e-9)
        assert math.isclose(row.rougeL.fmeasure, fl, rel_tol=1e-9)


def test_rouge_identity_and_empty(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("", "x"), ("x", "")], "c string, r string")
    s = rg.rouge_columns(df, "c", "r").collect()
    assert s[0].rouge1.fmeasure == 1.0 and s[0].rougeL.fmeasure == 1.0
    assert s[1].rouge1.fmeasure == 0.0 and s[2].rougeL.fmeasure == 0.0


def _dp_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_lcs_bit_parallel_matches_dp():
    import random
    rnd = random.Random(7)
    for _ in range(500):
        a = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 80))]
        b = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 80))]
        assert rg.lcs_length(a, b) == _dp_lcs(a, b)


def test_rougeL_query_against_brute_force(spark):
    """Registered rougeL_scores vs a plain-Python DP on the small fixture."""
    import re
    from __spark_entry__ import queries
    from conftest import SF_SMALL
    got = {r.id: r for r in queries()["rougeL_scores"](spark, SF_SMALL).collect()}
    from precis.plans.catalog import sm, tb
    rows = sm.summarize_lead(tb.articles(spark, SF_SMALL), 3).select("id", "summary", "target").collect()
    tok = lambda t: [x for x in re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split(" ") if x]
    assert len(got) == len(rows)
    for r in rows:
        c, t = tok(r.summary), tok(r.target)
        lcs = _dp_lcs(c, t) if c and t else 0
        p = lcs / max(len(c), 1)
        rc = lcs / max(len(t), 1)
        f = 2 * p * rc / (p + rc) if p + rc > 0 else 0.0
        assert got[r.id].rougeL_f == pytest.approx(round(f, 6), abs=1e-6)


def test_rouge_lsum_union(spark):
    # reference sentences vs candidate sentences, union LCS (Lin 2004, sec. 3.2)
    df = spark.createDataFrame([("w1 w2 w3 w4 w5", "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5")], "r string, c string")
    s = df.select(rg.rouge_lsum(F.col("c"), F.col("r")).alias("s")).first().s
    # union LCS hits = 4 (w1 w2 w3 w5); |ref| = 5, |cand| = 10
    assert s.recall == pytest.approx(4 / 5) and s.precision == pytest.approx(4 / 10)


def test_stemming_tokens(spark):
    df = spark.createDataFrame([("Police killed the gunmen running",)], "t string")
    r = df.select(rg.rouge_tokens(F.col("t"), stem=True).alias("x")).first().x
    assert r == ["polic", "kill", "the", "gunmen", "run"]


def test_bleu_identity(spark):
    df = spark.createDataFrame([("a b c d e f", "a b c d e f")], "c string, r string")
    assert rg.bleu(df, "c", "r").first().bleu == pytest.approx(1.0)


def _table_positions(r, c):
    """Indices of the LCS by the full table and the same rule of choice."""
    d = [[0] * (len(c) + 1) for _ in range(len(r) + 1)]
    for i in range(len(r)):
        for j in range(len(c)):
            d[i + 1][j + 1] = d[i][j] + 1 if r[i] == c[j] else max(d[i][j + 1], d[i + 1][j])
    out, i, j = set(), len(r), len(c)
    while i and j:
        if r[i - 1] == c[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif d[i - 1][j] >= d[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_traced_positions_equal_the_table():
    import random
    rnd = random.Random(8)
    for _ in range(600):
        letters = "abcdefg"[:rnd.randint(1, 7)]
        r = [rnd.choice(letters) for _ in range(rnd.randint(0, 70))]
        c = [rnd.choice(letters) for _ in range(rnd.randint(0, 140))]
        assert rg._lcs_positions(r, c) == _table_positions(r, c)


def test_long_lines_fit_in_memory():
    import random
    import tracemalloc
    rnd = random.Random(9)
    r, c = ([rnd.randrange(2000) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    got = rg._lcs_positions(r, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == rg.lcs_length(r, c) and peak < 120 << 20


def test_stemmed_query_against_brute_force(spark):
    import re
    from collections import Counter
    from __spark_entry__ import queries
    from conftest import SF_SMALL
    from precis.functions.porter import stem
    from precis.plans.catalog import sm, tb
    got = {r.id: r for r in queries()["rouge_stemmed"](spark, SF_SMALL).collect()}
    rows = sm.summarize_lead(tb.articles(spark, SF_SMALL), 3).select("id", "summary", "target").collect()
    tok = lambda t: [stem(x) if len(x) > 3 else x for x in re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).split(" ") if x]

    def f1(hits, nc, nr):
        p, r = hits / max(nc, 1), hits / max(nr, 1)
        return round(2 * p * r / (p + r) if p + r > 0 else 0.0, 6)

    assert len(got) == len(rows)
    for r in rows:
        c, t = tok(r.summary), tok(r.target)
        pairs = lambda x: list(zip(x, x[1:]))
        for name, a, b in (("rouge1_f", c, t), ("rouge2_f", pairs(c), pairs(t))):
            assert got[r.id][name] == pytest.approx(f1(sum((Counter(a) & Counter(b)).values()), len(a), len(b)), abs=1e-6)
        assert got[r.id]["rougeL_f"] == pytest.approx(f1(_dp_lcs(c, t), len(c), len(t)), abs=1e-6)


def test_batch_hits_equal_the_row_scores(spark):
    """Overlaps and LCS counted for a batch at once: nulls, empty lists, repeats and one row after another, against brute force."""
    import random
    from collections import Counter

    import pyarrow as pa

    from precis.operators import rouge as rg
    rnd = random.Random(5)
    make = lambda: rnd.choice([None, [], ["a"], [rnd.choice("abcde") for _ in range(rnd.randrange(30))]])
    a, b = ([make() for _ in range(300)] for _ in range(2))
    codes, rows = rg._coded(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())))
    for n in (1, 2, 3):
        grams = lambda x: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
        assert rg._overlap(codes, rows, n, 300).tolist() == [sum((grams(x or []) & grams(y or [])).values()) for x, y in zip(a, b)]
    assert rg._lcs_lengths(codes, rows, 300).tolist() == [rg.lcs_length(x or [], y or []) for x, y in zip(a, b)]
    t = spark.createDataFrame([(" ".join(x or []), " ".join(y or [])) for x, y in zip(a, b)], "c string, r string")
    got = rg.rouge_columns(t, "c", "r").withColumn("one", rg.rouge_n(rg.rouge_tokens("c"), rg.rouge_tokens("r"), 2)) \
        .withColumn("two", rg.rouge_l(rg.rouge_tokens("c"), rg.rouge_tokens("r")))
    assert got.where("rouge2 <> one OR rougeL <> two").count() == 0 and got.count() == 300
    empty = pa.array([], pa.list_(pa.string()))
    assert rg._overlap(*rg._coded(empty, empty), 2, 0).tolist() == [] and rg._lcs_lengths(*rg._coded(empty, empty), 0).tolist() == []

import pytest
from pyspark.sql import functions as F

from precis.operators import lm as lmx
from precis.operators import vectors as vx

# quoted golden values of the reference notebook (FIXTURES.md section 4)
Q = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
K = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
V = [[0.0, 1.0, 0.0], [1.0, 0.0, 1.0]]


@pytest.fixture(scope="module")
def qkv(spark):
    return spark.createDataFrame([(Q, K, V, [[True, True], [False, True]])],
                                 "q array<array<double>>, k array<array<double>>, v array<array<double>>, m array<array<boolean>>")


def test_scaled_scores(qkv):
    r = qkv.select(F.transform("q", lambda qi: F.transform("k", lambda kj: vx.dot(qi, kj) / F.sqrt(F.lit(3.0)))).alias("s")).first().s
    assert r[0] == pytest.approx([0.57735026, 2.309401], rel=1e-6)
    assert r[1] == pytest.approx([1.1547005, 2.8867514], rel=1e-6)


def test_masked_attention_gold(qkv):
    r = qkv.select(vx.attention("q", "k", "v", mask=F.col("m")).alias("a")).first().a
    assert r[0] == pytest.approx([0.8496746, 0.15032545, 0.8496746], rel=1e-6)
    assert r[1] == pytest.approx([1.0, 0.0, 1.0], abs=1e-7)


def test_causal_attention_gold(qkv):
    r = qkv.select(vx.attention("q", "k", "v", causal=True).alias("a")).first().a
    assert r[0] == pytest.approx([0.0, 1.0, 0.0], abs=1e-7)
    assert r[1] == pytest.approx([0.8496746, 0.15032543, 0.8496746], rel=1e-6)


def test_causal_mask(spark):
    r = spark.range(1).select(vx.causal_mask(3).alias("m")).first().m
    assert r == [[True, False, False], [True, True, False], [True, True, True]]


def test_multi_head_equals_single_head_per_slice(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    q, k, v = (rng.normal(size=(3, 4)).tolist() for _ in range(3))
    df = spark.createDataFrame([(q, k, v)], "q array<array<double>>, k array<array<double>>, v array<array<double>>")
    got = np.array(df.select(vx.multi_head_attention("q", "k", "v", 2, 4).alias("a")).first().a)
    Q, K, Vv = map(np.array, (q, k, v))
    out = []
    for h in range(2):
        s = Q[:, 2 * h:2 * h + 2] @ K[:, 2 * h:2 * h + 2].T / np.sqrt(2)
        w = np.exp(s - s.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        out.append(w @ Vv[:, 2 * h:2 * h + 2])
    assert got == pytest.approx(np.concatenate(out, 1), rel=1e-9)


def test_log_softmax_groups(spark):
    import math
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, x double")
    r = {(x.g, x.x): x.logp for x in lmx.log_softmax(df, ["g"], "x").collect()}
    lse = math.log(math.exp(1) + math.exp(2))
    assert r[("a", 1.0)] == pytest.approx(1 - lse) and r[("b", 5.0)] == pytest.approx(0.0)


@pytest.mark.parametrize("block_keys", [1, 7, 1024])
def test_attention_over_blocks_equals_numpy(spark, block_keys, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(2)
    q, k = rng.normal(size=(40, 6)) * 30, rng.normal(size=(50, 6)) * 30  # scores of several thousands
    k[20] = k[10]  # a tie goes to the smaller label
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "vec_id long, v array<double>")
    ks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(k)], "label int, proto array<double>")
    for forced in (False, True):
        if forced:
            monkeypatch.setattr(vx, "bounded_broadcast", lambda df: df)
        got = {r.vec_id: r for r in vx.attend(qs, ks, "vec_id", "v", "label", "proto", 6, block_keys).collect()}
        s = q @ k.T / np.sqrt(6)
        w = np.exp(s - s.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        assert len(got) == 40
        for i in range(40):
            assert got[i].best_label == int(s[i].argmax()) and got[i].best_weight == pytest.approx(w[i].max(), rel=1e-9)
            assert got[i].pooled == pytest.approx((w[i] @ k).tolist(), rel=1e-6, abs=1e-6)

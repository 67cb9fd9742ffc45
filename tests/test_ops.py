import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from precis.functions import arrays as ar
from precis.operators import batching as bt
from precis.operators import evaluate as ev
from precis.operators import packing as pk
from precis.operators import split as spx
from precis.operators import summarize as sm
from precis.operators import vocab as vc
from precis.sources import files as fl


def test_sample_vocab_gold(spark):
    s = fl.sample_pairs(spark)
    v = vc.build_vocab(s, ("dialogue", "summary"))
    assert v.count() == 70
    ids = {r.token: r.token_id for r in v.collect()}
    assert [ids[w] for w in ["to", "They", "you?", "meet", "at", "see", "you", "the", "What", "Mom", "wants", "visit."]] \
        == list(range(4, 16))
    q = spark.createDataFrame([("x", "They agree to eat burgers.")], "id string, t string")
    from precis.functions.text import whitespace_tokens
    e = vc.lookup_ids(q.select("id", whitespace_tokens("t").alias("w")), "w", v).first()
    assert e.ids == [5, 60, 4, 3, 18]
    assert vc.lookup_tokens(spark.createDataFrame([("x", [5, 4, 999])], "id string, ids array<int>"),
                            "ids", v).first().tokens == ["They", "to", ""]


def test_split_sizes_sample_union(spark):
    s = fl.sample_pairs(spark)
    u = spx.union_splits(s, s.orderBy("id").limit(10), s.orderBy("id").limit(10))
    u = u.withColumn("rid", F.monotonically_increasing_id().cast("string"))
    sizes = {r.split: r.rows for r in spx.split_sizes(spx.split_80_10_10(u, "rid")).collect()}
    assert sizes == {"train": 96, "validation": 12, "test": 12}


def test_positions_are_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    p = spx.split_80_10_10(df, buckets=7, positions=True)
    r = p.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()
    assert tuple(r) == (0, 4999, 5000)
    sizes = {x.split: x.rows for x in spx.split_sizes(p).collect()}
    assert sizes == {"train": 4000, "validation": 500, "test": 500}


def test_assign_batches_partition(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("id"))
    b = spx.assign_batches(df, 10)
    assert b.count() == 100 and b.groupBy("batch").count().where("count != 10").count() == 0
    assert spx.assign_batches(df, 10, drop_last=False).count() == 103


PACK_GOLD = [  # (article len, summary len, max) -> input_ids, loss_mask — FIXTURES.md
    (3, 2, 10, [0, 100, 101, 102, 4, 200, 201, 2, 1, 1], [0, 0, 0, 0, 0, 1, 1, 1, 0, 0]),
    (20, 5, 20, [0] + list(range(100, 112)) + [4] + list(range(200, 205)) + [2], [0] * 14 + [1] * 6),
    (20, 5, 16, [0] + list(range(100, 105)) + [4] + list(range(200, 205)) + [2, 1, 1, 1], [0] * 7 + [1] * 6 + [0] * 3),
    (5, 30, 16, [0] + list(range(100, 105)) + [4] + list(range(200, 208)) + [2], [0] * 7 + [1] * 9),
]


@pytest.mark.parametrize("la,ls,mx,ids,mask", PACK_GOLD)
def test_pack_gpt_gold(spark, la, ls, mx, ids, mask):
    df = spark.createDataFrame([(list(range(100, 100 + la)), list(range(200, 200 + ls)))], "a array<int>, s array<int>")
    r = df.select(pk.pack_gpt("a", "s", mx).alias("p")).first().p
    assert r.input_ids == ids and r.loss_mask == mask


def test_pack_lm_and_filter(spark):
    df = spark.createDataFrame([([5, 6], [7])], "a array<int>, s array<int>")
    r = df.select(pk.pack_lm("a", "s").alias("p")).first().p
    assert r.tokens == [5, 6, 1, 0, 7, 1] and r.mask == [0, 0, 0, 0, 1, 1] and r.length == 6
    long = spark.createDataFrame([(list(range(2049)),), ([1],)], "t array<int>")
    assert pk.filter_by_length(long, "t", 2048).count() == 1
    assert pk.validate_equal(spark.createDataFrame([([1], [1]), ([1], [2])], "a array<int>, b array<int>"), "a", "b").count() == 1


def test_bucket_gold(spark):
    df = spark.createDataFrame([(n,) for n in (127, 128, 255, 1023, 1024)], "n int")
    assert [r.b for r in df.select(bt.length_bucket("n").alias("b")).collect()] == [0, 1, 1, 3, 4]


def test_bucket_batches_complete(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") * 7 % 600).alias("len"))
    b = bt.bucket_by_length(df, "len")
    sizes = dict(zip(range(5), bt.BATCH_SIZES))
    for r in b.groupBy("bucket", "batch").count().collect():
        assert r["count"] == sizes[r.bucket]


def test_array_functions(spark):
    df = spark.createDataFrame([([5, 6, 7, 4, 8, 9],)], "a array<int>")
    r = df.select(ar.truncate_ids("a", 2).alias("t"), ar.pad_ids("a", 8).alias("p"), ar.pad_mask(ar.pad_ids("a", 8)).alias("m"),
                  ar.pad_to_power_of_two("a").alias("p2"), ar.prompt_of("a").alias("po"), ar.target_of("a").alias("ta"),
                  ar.strip_special_tokens(F.array(*[F.lit(x) for x in [1, 5, 2, 6, 2]]), "first").alias("sf"),
                  ar.strip_special_tokens(F.array(*[F.lit(x) for x in [1, 5, 6, 7]]), "ends").alias("se"),
                  ar.labels_to_ids(F.array(F.lit(5), F.lit(-100)), 0).alias("l"),
                  ar.shift_inputs("a").alias("si"), ar.shift_targets("a").alias("st"),
                  ar.guard_empty_ids(F.array().cast("array<int>")).alias("g")).first()
    assert r.t == [5, 6] and r.p == [5, 6, 7, 4, 8, 9, 0, 0] and r.m[-2:] == [True, True]
    assert r.p2 == [5, 6, 7, 4, 8, 9, 0, 0] and r.po == [5, 6, 7, 4] and r.ta == [8, 9]
    assert r.sf == [5, 6, 2] and r.se == [5, 6] and r.l == [5, 0] and r.si == [5, 6, 7, 4, 8] and r.st == [6, 7, 4, 8, 9]
    assert r.g == [3]


def _textrank_brute(sent_tokens, d=0.85, it=20):
    import numpy as np
    sets = [set(s) for s in sent_tokens]
    n = len(sets)
    w = np.array([[len(sets[i] & sets[j]) if i != j else 0 for j in range(n)] for i in range(n)], dtype=float)
    out = w.sum(axis=1)
    s = np.ones(n)
    for _ in range(it):
        q = np.where(out > 0, s / np.where(out > 0, out, 1), 0.0)
        s = (1 - d) + d * (w.T @ q)
    return s


def test_textrank_matches_dense_power_iteration(spark):
    import re
    text = ("The cat sat on the mat. The dog sat on the log. A bird flew over the cat and the dog. "
            "Nothing here matches. The mat and the log are old.")
    df = spark.createDataFrame([("d1", text)], "id string, source string")
    got = sm.summarize_textrank(df, 2, iterations=20).first().summary
    sents = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
    toks = [[x for x in re.sub(r"[^a-z0-9]+", " ", s.lower()).split(" ") if x] for s in sents]
    sc = _textrank_brute(toks)
    top = sorted(sorted(range(len(sents)), key=lambda i: (-sc[i], i))[:2])
    assert got == " ".join(sents[i] for i in top)


def test_failure_isolation(spark):
    df = spark.createDataFrame([("a", "Fine. text"), ("b", "no terminator"), ("c", "")], "id string, source string")

    def model(texts):
        if any("terminator" in t for t in texts):
            raise RuntimeError("boom")
        return [t[:4] for t in texts]
    out = ev.run_systems(df, {"m": lambda x: sm.summarize(x, model, system="m")})
    got = {r.id: r.status for r in out.collect()}
    assert got == {"a": "ok", "b": "Error", "c": "Missing"}


def test_poisson_weights_mean_one(spark):
    u = spark.range(200000).select((F.rand(3)).alias("u"))
    m = u.select(ev.poisson1(F.col("u")).alias("k")).agg(F.avg("k"), F.variance("k")).first()
    assert abs(m[0] - 1) < 0.02 and abs(m[1] - 1) < 0.03


def test_read_or_sample_and_csv_roundtrip(spark, tmp_path):
    df = fl.read_or_sample(spark, [str(tmp_path / "missing")])
    assert df.count() == 100
    out = str(tmp_path / "csv")
    fl.write_pairs_csv(df.withColumn("split", F.lit("train")), out)
    back = fl.read_pairs_csv(spark, out + "/split=train")
    assert back.count() == 100 and back.where(F.col("dialogue").contains("Messi")).count() == 20


def test_resume_rounds(spark, tmp_path):
    base = str(tmp_path / "rounds")
    assert fl.resume_from(spark, base) == -1
    fl.save_round(spark.range(3), base, 0)
    fl.save_round(spark.range(4), base, 1)
    assert fl.resume_from(spark, base) == 1
    built = []
    a = fl.ensure_artifact(spark, str(tmp_path / "art"), lambda: built.append(1) or spark.range(5))
    b = fl.ensure_artifact(spark, str(tmp_path / "art"), lambda: built.append(1) or spark.range(5))
    assert a.count() == b.count() == 5 and built == [1]


@pytest.mark.parametrize("vals,best,stop", [
    ([3.0, 2.5, 2.5, 2.6, 2.4, 2.41, 2.42, 2.4, 2.3], 5, 8),
    ([3, 2, 2.1, 1.9], 4, None),
])
def test_early_stopping_gold(spark, vals, best, stop):
    from precis.operators import trainlog as tl
    log = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(vals)], "run string, epoch int, val_loss double")
    s = tl.early_stopping_summary(tl.early_stopping(log, "val_loss", 3)).first()
    assert s.best_epoch == best and s.stop_epoch == stop


def test_sql_functions_match_dataframe(spark):
    from precis.functions import sqlfuncs as sq
    from precis.functions import text as tx
    sq.register_sql_functions(spark)
    df = spark.createDataFrame([("see http://x.y now, well-known (café)! ok",)], "t string")
    df.createOrReplaceTempView("t_sql")
    a = spark.sql("SELECT clean_text(t) AS c, whitespace_tokens(t) AS w FROM t_sql").first()
    b = df.select(tx.clean_text("t").alias("c"), tx.whitespace_tokens("t").alias("w")).first()
    assert a.c == b.c and a.w == b.w


def test_collate_and_tokenize_map(spark):
    from precis.operators import encode as en
    df = spark.createDataFrame([("a", 0, [1, 2, 3]), ("b", 0, [4]), ("c", 1, [5, 6])], "id string, batch int, ids array<int>")
    got = {r.id: r.ids for r in bt.collate_longest(df, "ids", ["batch"], pad=0).collect()}
    assert got == {"a": [1, 2, 3], "b": [4, 0, 0], "c": [5, 6]}
    v = fl.sample_pairs(spark)
    voc = vc.build_vocab(v, ("dialogue", "summary"))
    t = en.tokenize_map(v.withColumnRenamed("dialogue", "source").withColumnRenamed("summary", "target"),
                        voc, 5, 3, prefix="summarize:").where("id = '0'").first()
    assert len(t.input_ids) == 5 and t.input_ids[0] == 3 and len(t.labels) == 3


def test_import_bpe_files(spark, tmp_path):
    from precis.operators import bpe
    df = spark.createDataFrame([(" ".join(["low"] * 5 + ["lower"] * 2 + ["newest"] * 6 + ["widest"] * 3),)], "text string")
    m = bpe.train_bpe(df, ["text"], 270, 2)
    import json
    (tmp_path / "vocab.json").write_text(json.dumps({t: i for i, t in m.token.items()}), encoding="utf-8")
    (tmp_path / "merges.txt").write_text("#version: 0.2\n" + "\n".join(m.merges_text()) + "\n", encoding="utf-8")
    voc, mer = fl.import_bpe_files(spark, str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    assert voc.count() == m.vocab_size
    assert [f"{r.left} {r.right}" for r in mer.orderBy("rank").collect()] == m.merges_text()


def test_import_bpe_files_without_version_line(spark, tmp_path):
    (tmp_path / "vocab.json").write_text('{"a": 0}', encoding="utf-8")
    (tmp_path / "merges.txt").write_text("a b\n#version x\nc d\n", encoding="utf-8")
    _, mer = fl.import_bpe_files(spark, str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    assert [tuple(r) for r in mer.orderBy("rank").collect()] == [(0, "a", "b"), (1, "#version", "x"), (2, "c", "d")]


def test_cut_split_equals_positions(spark):
    for n in (0, 1, 2, 3, 9, 10, 11, 1000):
        df = spark.range(n).select(F.col("id").cast("string").alias("id"))
        a = {r.id: r.split for r in spx.split_80_10_10(df).collect()}
        assert a == {r.id: r.split for r in spx.split_80_10_10(df, positions=True).collect()}


def test_cut_split_moves_no_row(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "id")
    assert "Exchange" not in spx.split_80_10_10(df)._jdf.queryExecution().executedPlan().toString()


def test_failing_and_absent_systems(spark):
    from precis.operators import evaluate as ev
    df = spark.createDataFrame([("1", "a b", "a"), ("2", "c d", "c")], "id string, source string, target string")

    def broken(_):
        raise RuntimeError("no model")
    out = ev.run_systems(df, {"good": lambda d: d.withColumn("summary", F.col("source")), "broken": broken, "absent": None, "nothing": lambda d: None})
    got = {(r.system, r.status, r.error): r["count"] for r in out.groupBy("system", "status", "error").count().collect()}
    assert got == {("good", "ok", None): 2, ("broken", "Error", "RuntimeError: no model"): 2, ("absent", "Missing", None): 2, ("nothing", "Missing", None): 2}


def test_zip_pairs_is_one_to_one(spark):
    from precis.operators import evaluate as ev
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "id int, b string")
    assert sorted(tuple(r) for r in ev.zip_pairs(a, b).collect()) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(Exception, match="more than once"):
        ev.zip_pairs(a.unionByName(a), b).collect()


def test_text_documents_and_corpus_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("héllo\nworld", encoding="utf-8")
    d = fl.read_text_documents(spark, str(tmp_path / "in"))
    r = d.first()
    assert r.text == "héllo\nworld" and r.path.endswith("a.txt")
    fl.write_corpus_lines(spark.createDataFrame([("s", "t")], "source string, target string"), str(tmp_path / "c"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "c")).collect()) == ["s", "t"]


def test_latency_and_metric_callbacks(spark):
    df = spark.createDataFrame([("a", "One. two"), ("b", "Three.")], "id string, source string")
    out = ev.run_systems(df, {"m": lambda x: sm.summarize(x, lambda ts: [t[:3] for t in ts], system="m")})
    lat = ev.latency_stats(out).first()
    assert lat.avg_ms >= 0
    sc = ev.score_systems(out.withColumn("target", F.col("source")), kinds=("rouge1",))
    res = ev.run_metrics(sc, [lambda s: ev.mean_scores(s, ("rouge1",)), lambda s: ev.status_counts(s).groupBy("system").count()])
    assert res.count() == 1


def test_replicate_weights_are_poisson1(spark):
    k = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint")
    x = spark.range(2000).select(k.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("b"))
    m = x.select(ev.poisson1(ev.replicate_uniform(F.col("k"), F.col("b"))).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(m[0] - 1) < 0.03 and abs(m[1] - 1) < 0.05


def test_replicate_sums_equal_exploded_weights(spark):
    import random
    from precis.operators import evaluate as ev
    rnd = random.Random(1)
    rows = [(f"s{i % 3}", rnd.randrange(1 << 32), rnd.random() if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "system string, _k long, _x double").repartition(4)
    ex = df.where("_x IS NOT NULL").select("system", "_k", "_x", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("b"))
    ex = ex.withColumn("w", ev.poisson1(ev.replicate_uniform(F.col("_k"), F.col("b"))))
    want = {(r.system, r.b): (r.w, r.wx) for r in ex.groupBy("system", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("_x")).alias("wx")).collect()}
    got = {(r.system, r.b + 1): (r.w, r.wx) for r in ev.replicate_sums(df, ["system"], 50).collect()}
    assert got.keys() == want.keys()
    for k, (w, wx) in want.items():
        assert got[k][0] == w and abs(got[k][1] - wx) < 1e-9
    small, ev.GROUPS = ev.GROUPS, 1  # groups beyond what a task holds are passed on
    try:
        again = {(r.system, r.b + 1): r.w for r in ev.replicate_sums(df, ["system"], 50).collect()}
    finally:
        ev.GROUPS = small
    assert again == {k: w for k, (w, _) in want.items()}


def test_language_by_join_and_by_profile_arrays(spark):
    from precis.operators import lang as lg
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "lang", "text")
    odd = spark.createDataFrame([("none", None, None), ("empty", "", ""), ("digits", "", "12 34"), ("far", "", "\u65e5\u672c \U00020000")], docs.schema)
    docs = docs.unionByName(odd)
    prof = lg.fit_language_profiles(docs.where("lang != ''"), "lang", "text").checkpoint()
    a = {r.id: r.detected for r in lg.detect_language(docs, prof).collect()}
    b = {r.id: r.detected for r in lg.detect_language(docs, prof, profile_rows=10).collect()}
    assert a == b and a["none"] == a["empty"] == a["digits"] == "en" and len(set(a.values())) > 2


def test_textrank_equals_dense_over_a_table(spark):
    import re
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", sm._token_lines(sm.sentences(sm.clean_text(F.col("text")), cleaned=True)).alias("t")).collect()
    assert len(rows) == 200
    for r in rows:
        toks = [line.split(" ") if line else [] for line in r.t.split("\n")]
        if len(toks) > 400:
            continue
        want, got = _textrank_brute(toks), sm.textrank_scores(r.t)
        for w, g, t in zip(want, got, toks, strict=True):
            assert (g == -1.0) if not t else abs(w - g) < 1e-8
    assert sm.textrank_scores("").tolist() == [-1.0] and sm.frequency_scores("").tolist() == [-1.0]
    assert re.match("[a-z0-9 \n]*$", rows[0].t)


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    import os
    folder = str(tmp_path)

    def load():
        import uuid as u
        with open(os.path.join(folder, f"{os.getpid()}-{u.uuid4().hex}"), "w"):
            pass
        return lambda texts: [str(len(t.split())) for t in texts]

    df = spark.createDataFrame([(str(i), "w " * (i * 10)) for i in range(200)], "id string, source string").repartition(8)
    got = {r.id: r.summary for r in sm.summarize_loaded(df, load, batch_size=3).collect()}
    assert got == {str(i): str(min(i * 10, 512)) for i in range(200)}
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) > 0  # many batches, one load per process


def test_look_up_by_dictionary_and_by_join(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6), ("", 7)], "token string, token_id int")
    rows = [("r1", ["a", "zz", "b", "a"], [4, 5, 99]), ("r2", [], []), ("r3", None, None), ("r4", ["c"] * 1000, [6] * 1000), ("r5", ["", "a"], [7])]
    df = spark.createDataFrame(rows, "id string, w array<string>, i array<int>").repartition(3)
    all_ = {r.id: (r.x, r.y) for r in vc.encode_columns(df, [("w", "x", 3), ("w", "y", None)], vocab).collect()}
    assert all_["r1"] == ([4, 3, 5], [4, 3, 5, 4]) and all_["r2"] == all_["r3"] == ([], []) and all_["r5"][1] == [7, 4]
    assert all_["r4"] == ([6] * 3, [6] * 1000)
    plan = vc.encode_columns(df, [("w", "x", 3)], vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    for small in (40, 0):  # the part in use, and a join
        assert {r.id: (r.x, r.y) for r in vc.encode_columns(df, [("w", "x", 3), ("w", "y", None)], vocab, max_bytes=small).collect()} == all_
    back = [{r.id: r.tokens for r in vc.lookup_tokens(df, "i", vocab, max_bytes=n).collect()} for n in (1 << 20, 0)]
    assert back[0] == back[1] and back[0]["r1"] == ["a", "b", ""] and back[0]["r3"] == []

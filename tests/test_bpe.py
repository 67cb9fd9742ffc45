"""Byte-level BPE against hand-known values and (if installed) the
`tokenizers` package as a test-only oracle."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from precis.operators import bpe

CORPUS = [" ".join(["low"] * 5 + ["lower"] * 2 + ["newest"] * 6 + ["widest"] * 3), "hi café's 12 don't   x"]
FIRST_MERGES = ["e s", "es t", "l o", "lo w", "e w", "n ew", "Ġ low", "Ġ new", "Ġnew est", "d est", "i dest",
                "w idest", "Ġ widest", "e r", "Ġlow er"]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    return bpe.train_bpe(df, ["text"], 280, 2)


def test_alphabet_ids():
    ids = bpe.symbol_ids()
    assert sorted(ids) == list(range(5, 261))
    assert ids[ord("!")] == 5 and bpe.byte_symbols()[ord(" ")] == "Ġ"


def test_merges_gold(model):
    assert model.vocab_size == 276
    assert model.merges_text() == FIRST_MERGES
    assert model.token[262] == "est"


def test_tie_break_lowest_ids(spark):
    for txt in ("ab ab cd cd", "cd cd ab ab"):
        m = bpe.train_bpe(spark.createDataFrame([(txt,)], "text string"), ["text"], 262, 2)
        assert m.merges_text() == ["a b"]


def test_encode_decode(spark, model):
    df = spark.createDataFrame([("lowest newer hi",), ("naïve — 東京 don't\n\n x",)], "t string")
    e = df.select("t", bpe.encode_bpe(spark, "t", model).alias("ids"))
    e = e.select("t", "ids", bpe.decode_bpe(spark, "ids", model).alias("back")).collect()
    assert e[0].ids == [264, 262, 268, 274, 225, 76, 77]
    assert all(r.back == r.t for r in e)


def test_matches_tokenizers_on_documents(spark, tmp_path):
    tk = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(40)
    texts = [r.text for r in docs.collect()]
    p = tmp_path / "corpus.txt"
    p.write_text("\n".join(texts) + "\n", encoding="utf-8")
    ref = tk.ByteLevelBPETokenizer()
    ref.train([str(p)], vocab_size=261 + 25, min_frequency=2, special_tokens=list(bpe.BPE_SPECIALS))
    ref.save_model(str(tmp_path))
    want = (tmp_path / "merges.txt").read_text(encoding="utf-8").splitlines()[1:]
    lines = spark.createDataFrame([(t + "\n",) for t in texts], "text string")
    got = bpe.train_bpe(lines, ["text"], 261 + 25, 2)
    assert got.merges_text() == want
    enc = spark.createDataFrame([(texts[0],)], "t string").select(bpe.encode_bpe(spark, "t", got).alias("i")).first().i
    assert enc == ref.encode(texts[0]).ids


def test_roundtrip_query(spark):
    from __spark_entry__ import queries
    r = queries()["bpe_roundtrip"](spark, SF_SMALL).first()
    assert r.mismatches == 0 and r.tokens > 0


def test_resume(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    state = str(tmp_path / "bpe_state")
    a = bpe.train_bpe(df, ["text"], 261 + 10, 2, state_dir=state)
    b = bpe.train_bpe(df, ["text"], 280, 2, state_dir=state)  # resumes at round 10
    assert b.merges_text() == FIRST_MERGES and a.merges_text() == FIRST_MERGES[:10]


def one_at_a_time(words, vocab_size, min_frequency=2):
    """Merges by recounting every pair of every word before each merge."""
    rows, merges = [(list(s), f) for s, f in words], []
    while 261 + len(merges) < vocab_size:
        counts = {}
        for s, f in rows:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + f
        best = min(counts.items(), key=lambda c: (-c[1], c[0]), default=None)
        if best is None or best[1] < min_frequency:
            break
        (l_, r_), new = best[0], 261 + len(merges)
        merges.append((l_, r_, new))
        rows = [(bpe.merged(s, l_, r_, new), f) for s, f in rows]
        rows = [(s, f) for s, f in rows if len(s) > 1]
    return merges


def test_epochs_equal_one_at_a_time(spark):
    """Random words over few letters (runs, overlaps, many ties), with so little room that there are many epochs."""
    import random
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("aab") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 40))) for _ in range(30)]
    texts += ["aaaaaaaaaaaaaaaaaaaaaaaaaa " * 3, "", None, "\u65e5\u672c \u65e5\u672c\u8a9e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = [(r.syms, r.freq) for r in bpe.word_table(df, ["text"]).collect()]
    want = one_at_a_time(words, 30000)
    assert len(want) > 100
    for symbols, pairs in ((60, 2), (400, 16), (1 << 20, 512)):
        assert bpe.train_bpe(df, ["text"], 30000, 2, segment_symbols=symbols, first_pairs=pairs).merges == want
    assert bpe.train_bpe(df, ["text"], 261 + 33, 2, segment_symbols=200, first_pairs=8).merges == want[:33]


def test_all_documents_equal_tokenizers(spark, tmp_path):
    """Every document of the small table, until no pair occurs twice."""
    tk = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [r.text for r in docs.collect()]
    ref = tk.ByteLevelBPETokenizer()
    ref.train_from_iterator(texts, vocab_size=30000, min_frequency=2, special_tokens=list(bpe.BPE_SPECIALS), show_progress=False)
    ref.save_model(str(tmp_path))
    want = (tmp_path / "merges.txt").read_text(encoding="utf-8").splitlines()[1:]
    got = bpe.train_bpe(docs, ["text"], 30000, 2, segment_symbols=20_000)
    assert got.merges_text() == want and len(want) > 3000


def test_model_from_files(spark, tmp_path, model):
    from precis.sources import files as fl
    v, m = str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt")
    fl.export_bpe_files(model.vocab_df(spark), model.merges_df(spark).select("rank", "left", "right"), v, m)
    back = bpe.BpeModel.from_tables(*fl.import_bpe_files(spark, v, m))
    assert back.merges == model.merges and back.token == model.token
    short = model.vocab_df(spark).where("id < 270")
    with pytest.raises(ValueError):
        bpe.BpeModel.from_tables(short, fl.import_bpe_files(spark, v, m)[1])


def test_files_query(spark):
    from __spark_entry__ import queries
    r = queries()["bpe_files_roundtrip"](spark, SF_SMALL).first()
    assert r.differences == 0 and r.tokens > 0


def test_words_merged_together_equal_one_merge_at_a_time():
    """Many words at once, runs of one symbol, empty and long ones: as if the lowest merge were made again and again."""
    import random
    import numpy as np
    rnd = random.Random(3)
    merges, known = [], list(range(4))
    for n in range(4, 60):
        pair = rnd.choice(known), rnd.choice(known)
        if pair not in {m[:2] for m in merges}:
            merges.append((*pair, n))
            known.append(n)
    rank = {m[:2]: m for m in reversed(merges)}
    order = {m[:2]: i for i, m in enumerate(merges)}

    def plain(x):
        while True:
            best = min((order[p] for p in zip(x, x[1:]) if p in rank), default=None)
            if best is None:
                return x
            x = bpe.merged(x, *merges[best])

    words = [[rnd.randrange(4) for _ in range(rnd.choice([0, 1, 2, 3, 9, 40]))] for _ in range(400)]
    words += [[0] * k for k in range(9)] + [[rnd.randrange(4) for _ in range(bpe.LONG_WORD + k)] for k in (0, 1, 200)] + [[1] * 700]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    values, ends = bpe.MergeTable(merges).apply(np.array([x for w in words for x in w], np.int64), offsets)
    got = [values[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [plain(w) for w in words]


def test_ids_do_not_hang_on_a_cache(spark):
    """More distinct words than any cache would hold, nulls and empty texts among the rows: ids decode to the text."""
    m = bpe.train_bpe(spark.createDataFrame([("abc abd abe bcd " * 9,)], "t string"), ["t"], 300)
    x = spark.range(70_000).selectExpr("CASE WHEN id % 1000 = 7 THEN NULL WHEN id % 1000 = 8 THEN '' ELSE concat('é', hex(id), ' abcd', id) END AS t").coalesce(1)
    back = x.select("t", bpe.encode_bpe(spark, "t", m).alias("i")).select("t", F.size("i").alias("n"), bpe.decode_bpe(spark, "i", m).alias("b"))
    assert back.where("b <> coalesce(t, '') OR n IS NULL OR n = 0 AND coalesce(t, '') <> ''").count() == 0 and back.count() == 70_000

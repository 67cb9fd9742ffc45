from pyspark.sql import functions as F

from precis.functions import text as tx
from precis.functions.porter import stem

# gold values (FIXTURES.md section 4)
CLEAN = [
    ("Amanda: I baked  cookies. Do you want some?\r\nJerry: Sure! :-)", "Amanda I baked cookies. Do you want some? Jerry Sure!"),
    ("see http://x.y/z?q=1 now", "see now"),
    ("xhttpfoo http https://", "x http"),
    ("well-known (café) #1 @bob a_b", "wellknown café 1 bob a_b"),
    ("\U0001F600\U0001F680", ""),
    ("it's 5 pm, ok?", "it's 5 pm, ok?"),
    (None, ""),
]


def test_clean_text_gold(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tx.clean_text("t").alias("c")).collect()}
    for i, (_, want) in enumerate(CLEAN):
        assert got[i] == want, (CLEAN[i], got[i])


def test_unicode_whitespace_and_tamil(spark):
    import re
    samples = ["a b c　d", "x\x1cy\x85z", "தமிழ் மொழி", "తెలుగు భాష", "naïve café"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r.c for r in df.select(tx.clean_text("t").alias("c")).collect()]

    def py_clean(t):
        t = re.sub(r"http\S+", "", t)
        t = re.sub(r"[^\w\s.,!?']", "", t)
        return re.sub(r"\s+", " ", t).strip()
    assert got == [py_clean(s) for s in samples]


def test_whitespace_tokens_and_sentences(spark):
    df = spark.createDataFrame([("  a b\t\nc  ", "One. Two!  Three? four")], "t string, s string")
    r = df.select(tx.whitespace_tokens("t").alias("w"), tx.sentences("s").alias("s"),
                  tx.sentence_lines("s").alias("l")).first()
    assert r.w == ["a", "b", "c"]
    assert r.s == ["One.", "Two!", "Three?", "four"]
    assert r.l == "One.\nTwo!\nThree?\nfour"


def test_small_string_functions(spark):
    df = spark.createDataFrame([("abcdef", "Ünïcode ok", "fr")], "a string, b string, c string")
    r = df.select(tx.preview_text("a", 3).alias("p"), tx.add_prefix("a").alias("x"),
                  tx.ascii_fallback("b").alias("asc"), tx.language_label("c").alias("u"),
                  tx.format_score(F.lit(0.123456789)).alias("f"),
                  tx.expand_contractions(F.lit("I can't, they're here")).alias("e")).first()
    assert r.p == "abc..." and r.x == "summarize: abcdef" and r.asc == "ncode ok" and r.u == "FR"
    assert r.f.value == 12.3457 and r.f.text == "12.3457"
    assert r.e == "I cannot, they are here"


def test_wrap_text(spark):
    import textwrap
    s = " ".join(["word%d" % i for i in range(60)])
    r = spark.createDataFrame([(s,)], "t string").select(tx.wrap_text("t", 70).alias("w")).first()
    assert r.w == textwrap.fill(s, 70)
    odd = ["x" * 100, "ab " + "y" * 200 + " cd ef", "", "one", "w " * 90, "z" * 70, "z" * 70 + " " + "q" * 71, "aa " * 20 + "v" * 75 + " end"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tx.wrap_text("t", 70).alias("w")).collect()
    for row in rows:
        assert row.w == textwrap.fill(row.t, 70)


def test_porter_paper_examples():
    gold = dict(caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre",
                plastered="plaster", motoring="motor", sing="sing", conflated="conflat", troubled="troubl",
                sized="size", hopping="hop", falling="fall", filing="file", happy="happi", sky="sky",
                relational="relat", conditional="condit", generalizations="gener", oscillators="oscil",
                effective="effect", adjustment="adjust", controll="control", roll="roll")
    assert {k: stem(k) for k in gold} == gold


def test_decode_utf8_and_length_quantiles(spark):
    from precis.operators.encode import length_stats
    df = spark.createDataFrame([(bytearray("café".encode("utf-8")), "a b c"), (bytearray(b"x"), "a")], "b binary, t string")
    assert [r.s for r in df.select(tx.decode_utf8("b").alias("s")).collect()] == ["café", "x"]
    r = length_stats(df, "t", 2, quantiles=[0.5]).first()
    assert r.max_tokens == 3 and r.share_over == 0.5 and r.quantiles[0] in (1, 3)

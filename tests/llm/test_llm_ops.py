"""The ten operators against brute force, round trips and their contracts on small tables."""
import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from precis.llm import (  # noqa: E402
    chat, html_main, jaccard_rtree, kernels, langid, merkle, mih, mixing, packing, queries, suffix_dedup, urlfilter)
from precis.llm.common import texts_of  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(20_000))
ODD = [(1, ""), (2, None), (3, "one"), (4, "same text of a few words"), (5, "same text of a few words"), (5, "same text of a few words"),
       (None, "no id at all here"), (7, " \t\n "), (8, LONG), (9, LONG + " end"), (10, "naïve café 日本語 😀 " * 40), (11, "x" * 900)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and an extra column with a clashing name."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0) for i, t in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int")


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1
def test_suffix_sort_is_a_sort():
    rnd = random.Random(3)
    for _ in range(60):
        blobs = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 40))]
        group = np.sort(np.array([rnd.randint(0, 3) for _ in blobs]))
        size = np.array([len(b) for b in blobs])
        end = np.cumsum(size)
        order = suffix_dedup.suffix_sort(suffix_dedup._Suffixes(np.frombuffer(b"".join(blobs), np.uint8), end - size, size), group)
        assert [blobs[i] for i in order] == [blobs[i] for i in sorted(range(len(blobs)), key=lambda i: (group[i], blobs[i], i))]


def test_hash_collision_is_corrected():
    s = suffix_dedup._Suffixes(np.frombuffer(b"abcabd", np.uint8), np.array([0, 3]), np.array([3, 3]))
    assert s.verified(np.array([0]), np.array([1]), np.array([3])).tolist() == [2]


def check_removed(df, length):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_digests(df, length).collect()}
    want = {i: (n, m, s, hashlib.sha256(kept).hexdigest(), m > 0) for i, (n, m, s, kept) in brute.repeated(pairs(df), length).items()}
    assert got == want


def test_suffix_dedup_real(docs):
    check_removed(docs, 400)
    check_removed(docs, 200)


def test_suffix_dedup_made(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(900)) for _ in range(3)]
    texts = ["", "a" * 399, "a" * 400, "a" * 401, "b" * 1000, "b" * 450, "ab" * 700, "ab" * 300 + "c" + "ab" * 300, None]
    for _ in range(90):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("XYZ")
        a = rnd.randrange(400)
        texts.append("".join(t)[a:a + rnd.randint(300, 800)] + "é" * rnd.randint(0, 5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_removed(df, 400)
    wide, suffix_dedup.WIDE = suffix_dedup.WIDE, 3  # grams with more contexts are counted
    try:
        check_removed(df, 400)
    finally:
        suffix_dedup.WIDE = wide


def test_suffix_dedup_deals_out_wide_grams(spark, monkeypatch):
    rnd = random.Random(8)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, rows = some(700), []
    for _ in range(80):
        a = rnd.choice([0, 0, 100, rnd.randrange(300)])
        rows.append(some(rnd.randrange(300)) + shared[a:a + rnd.choice([700, 500, 401, 399])] + some(rnd.randrange(300)))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    dealt, halves = [], suffix_dedup._halves
    monkeypatch.setattr(suffix_dedup, "WIDE", 5)
    monkeypatch.setattr(suffix_dedup, "_halves", lambda c, length: dealt.append((c.count(), halves(c, length).count())) or halves(c, length))
    check_removed(df, 400)
    # two rows a context and level, not one for each of its 361 windows; levels shrink as members agree
    assert len(dealt) > 2 and all(n <= 2 * c for c, n in dealt)
    assert sum(n for _, n in dealt) < 40 * dealt[0][0]


def test_suffix_dedup_makes_contexts_once(spark, monkeypatch):
    rnd = random.Random(8)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = some(700)
    df = spark.createDataFrame([(i, some(rnd.randrange(300)) + shared + some(100)) for i in range(20)], "doc_id long, text string")
    plans, resolved = [], suffix_dedup._resolved
    monkeypatch.setattr(suffix_dedup, "WIDE", 5)
    monkeypatch.setattr(suffix_dedup, "_resolved", lambda contexts, *a: plans.append(
        contexts._jdf.queryExecution().optimizedPlan().toString()) or resolved(contexts, *a))
    check_removed(df, 400)
    # with wide grams the contexts of the others are read again, not cut from the texts once more
    assert len(plans) > 1 and "MapInArrow" not in plans[0]


def test_windows_in_blocks(monkeypatch):
    rnd = random.Random(9)
    text = bytes(rnd.choice(b"abcd") for _ in range(1300))
    blobs, left = [], []
    for _ in range(60):
        b = bytearray(text)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(1300)
            if not 600 <= at < 640:
                b[at] = ord("X")
        a, z = 600 - rnd.randint(0, 360), 640 + rnd.randint(0, 360)
        blobs.append(bytes(b[a:z]))
        left.append(600 - a)
    left = np.array(left)
    seen = Counter((o, b[x - o:x - o + 400]) for b, x in zip(blobs, left.tolist(), strict=True) for o in range(361) if x >= o and len(b) >= x - o + 400)
    want = set()
    for i, (b, x) in enumerate(zip(blobs, left.tolist(), strict=True)):
        want |= {(i, at) for o in range(361) if x >= o and len(b) >= x - o + 400 and seen[o, b[x - o:x - o + 400]] > 1 for at in range(-o, 400 - o)}
    for cells in (1 << 17, 1, 200):
        monkeypatch.setattr(suffix_dedup, "CELLS", cells)
        found = suffix_dedup.repeated_spans(np.zeros(60, np.int64), left, blobs, 400)
        assert {(i, at) for i, a, z in zip(*(x.tolist() for x in found), strict=True) for at in range(a, z)} == want


def test_suffix_dedup_odd(odd, none):
    rows = suffix_dedup.dedup_digests(odd, 400).collect()
    assert len(rows) == len(ODD)
    gone = {r["doc_id"]: r["n_removed"] for r in rows}
    assert gone[8] == len(LONG) and gone[9] == len(LONG) and gone[2] == gone[1] == 0 and gone[11] == 900
    assert suffix_dedup.dedup_digests(none, 400).collect() == []
    kept = suffix_dedup.dedup_texts(odd, 200)
    assert kept.columns == odd.columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 8 not in left and left[9] == " end" and left[2] is None and left[1] == ""
    assert left.get(10, "").encode().decode() == left.get(10, "")


# ---------------------------------------------------------------- 2
def test_rates_meet_targets(spark):
    rnd = np.random.default_rng(4)
    p = rnd.dirichlet([2.0, 0.3, 0.2], 400)
    tokens = rnd.integers(1, 900, 400)
    rows = [(i, int(t), 1 + i % 2, [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))]
    members = spark.createDataFrame(rows, "_key long, n_tokens long, rows long, p array<double>")
    x = tokens * (1 + np.arange(400) % 2).astype(float)
    have = (x[:, None] * p).sum(axis=0)
    for shares, most in (([0.7, 0.2, 0.1], None), ([0.9, 0.1, 0.0], None), (list(have / have.sum() * [1, 0.8, 0.6]), 1.0)):
        shares = np.array(shares) / sum(shares)
        budget = 0.6 * min(h / s for h, s in zip(have, shares, strict=True) if s)
        got = {r["_key"]: r["rate"] for r in mixing.fit_rates(members, list(shares), budget, most).collect()}
        rate = np.array([got[i] for i in range(400)])
        assert (rate >= 0).all() and (most is None or (rate <= most).all())
        error = (x[:, None] * p * rate[:, None]).sum(axis=0) - budget * shares
        assert (abs(error) <= 1e-3 * have).all() or shares[2] == 0
        if shares[2] == 0:  # out of reach with soft posteriors: no step along the gradient helps any more
            assert error[2] > 0 and abs(error[:2]).max() < 0.1 * have.max()


def settled_rates(x, p, want, most, inverse, steps=20_000):
    """The same least squares by plain projected gradient in one place, run until nothing moves."""
    r = np.ones(len(x))
    for _ in range(steps):
        e = (x[:, None] * p * r[:, None]).sum(axis=0) - want
        new = np.clip(r - p @ (inverse @ e), 0, most)
        if abs(new - r).max() < 1e-12:
            break
        r = new
    return r


@pytest.mark.parametrize("seed", range(4))
def test_rates_reach_the_constrained_optimum(spark, seed):
    """Scarce domains, soft posteriors and limited rates: the error never rises and ends at the optimum."""
    rnd = np.random.default_rng(seed)
    alpha = [[8.0, 0.3, 0.2, 0.05], [0.2, 0.2, 3.0, 0.1]][seed % 2]
    p = rnd.dirichlet(alpha, 500)
    tokens = rnd.integers(1, 900, 500)
    shares = np.array([0.005, 0.03, 0.95, 0.015] if seed < 2 else [0.03, 0.005, 0.015, 0.95])
    members = spark.createDataFrame([(i, int(t), 1, [float(v) for v in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))],
                                    "_key long, n_tokens long, rows long, p array<double>")
    x = tokens.astype(float)
    have = (x[:, None] * p).sum(axis=0)
    inverse = np.linalg.pinv((x[:, None] * p).T @ p, rcond=1e-9, hermitian=True)
    budget = 0.5 * x.sum()
    want = np.minimum(budget * shares, have)
    trace = []
    got = {r["_key"]: r["rate"] for r in mixing.fit_rates(members, list(shares), budget, 1.0, trace).collect()}
    rate = np.array([got[i] for i in range(500)])
    assert all(b <= a * (1 + 1e-9) for a, b in zip(trace, trace[1:]))
    best = settled_rates(x, p, want, 1.0, inverse)
    size = lambda r: (lambda e: e @ inverse @ e)((x[:, None] * p * r[:, None]).sum(axis=0) - want)
    assert size(rate) <= size(best) + 3e-3 * trace[0] + 1e-6 * x.sum(), (size(rate), size(best), trace)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_mixture_keeps_most_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert mixing.apply_rates(docs, labels, most=1.0).count() > 0.5 * docs.count()


def test_scarce_unwanted_domain_costs_no_clean_documents(spark):
    rnd = np.random.default_rng(8)
    p = np.where(rnd.random((400, 1)) < 0.8, [[0.0199, 0.0001, 0.96, 0.02]], [[0.8499, 0.0001, 0.10, 0.05]])
    shares = [mixing.TARGETS[x] for x in sorted(mixing.TARGETS)]
    members = spark.createDataFrame([(i, 100, 1, [float(v) for v in x]) for i, x in enumerate(p)], "_key long, n_tokens long, rows long, p array<double>")
    got = {r["_key"]: r["rate"] for r in mixing.fit_rates(members, shares, most=1.0).collect()}
    rate = np.array([got[i] for i in range(400)])
    clean = p[:, 2] > 0.5
    assert (rate <= 1).all() and rate[clean].mean() > 0.95 and rate[~clean].mean() < 0.6, (rate[clean].mean(), rate[~clean].mean())


def test_mixing_separates_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = mixing.rates(docs, labels)
    assert r.count() == docs.count()
    rate = {(x[0], x[1]): x[2] for x in r.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg("rate")).collect()}
    assert rate[1, 0] > 0.9 and rate[1, 1] < 0.7


def test_mixing_tells_every_domain(spark):
    """Learned from two thirds of the labels: the held-out documents of each domain are told, and so are their shares."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    names = sorted(mixing.TARGETS)
    weights = mixing.feature_weights(docs, labels.where(~fold), names, mixing.domain_of())
    held = labels.where(fold).select("doc_id", mixing.domain_of().alias("domain"))
    p = mixing.posteriors(docs.join(held, "doc_id", "left_semi"), weights, len(names)).join(held, "doc_id")
    rows = [(names.index(r["domain"]), r["p"]) for r in p.select("domain", "p").collect()]
    true, p = np.array([t for t, _ in rows]), np.array([x for _, x in rows])
    told = {x: (p[true == i].argmax(axis=1) == i).mean() for i, x in enumerate(names)}
    assert told["q0_t0"] >= 0.8 and told["q1_t0"] >= 0.97 and told["q1_t1"] >= 0.8 and told["q0_t1"] >= 0.2, told
    share = np.bincount(true, minlength=len(names)) / len(true)
    assert (abs(p.mean(axis=0) - share) <= 0.02).all()


def test_mixing_tells_repeats_symbols_and_capitals(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    low = [lambda: " ".join([word()] * 60), lambda: " ".join(word() + "%&*$"[rnd.randrange(4)] * 3 for _ in range(60)),
           lambda: " ".join(word().upper() for _ in range(60))]
    rows = [(i, low[i % 3]() if i % 6 < 3 else " ".join(word() for _ in range(60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 >= 3), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    r = mixing.rates(docs, labels).where("doc_id >= 300").collect()
    assert len(r) == 300 and all((x["p_q0_t0"] > 0.5) == (x["doc_id"] % 6 < 3) for x in r)


def test_mixing_learns_from_every_labelled_row(spark):
    """A word that 6 of 24,000 labelled documents have is counted, and the prior is fitted to all of them."""
    rows = [(i, ("bad ugly" if i % 10 == 0 else "good nice") + (" rare" if i % 4000 == 0 else "")) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    names = sorted(mixing.TARGETS)
    lab = mixing._labelled(labels, names, mixing.domain_of(), "doc_id")
    weights, size, _ = mixing._learned(docs, lab, names, "text", "doc_id")
    assert size == [2400, 0, 21_600, 0] and {"bad", "rare"} <= {r["feature"] for r in weights.collect()}
    p = mixing.posteriors(docs, mixing.feature_weights(docs, labels, names, mixing.domain_of()), len(names))
    mean = np.array(p.agg(*[F.avg(F.col("p")[i]) for i in range(4)]).first())
    assert (abs(mean - [0.1, 0, 0.9, 0]) <= 2e-3).all(), mean
    r = mixing.rates(docs, labels).agg(F.avg("p_q0_t0"), F.count("*")).first()
    assert abs(r[0] - 0.1) <= 2e-3 and r[1] == 24_000


def test_mixing_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.rates(odd, labels).count() == len(ODD)
    assert mixing.apply_rates(odd, labels, most=1.0).columns == odd.columns
    assert mixing.rates(none, labels).count() == 0
    assert mixing.rates(odd, labels.limit(0)).count() == len(ODD)


def test_mixing_makes_features_once(docs, spark):
    weights = spark.createDataFrame([("\u0001bias", [0.1, 0.2])], "feature string, w array<double>")
    plan = mixing.posteriors(docs, weights, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    lab = mixing._labelled(spark.read.parquet(f"{SMALL}/labels.parquet"), sorted(mixing.TARGETS), mixing.domain_of(), "doc_id")
    plan = mixing._few(docs, lab, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the same plan for tables of any size


def test_mixing_is_native(docs, spark):
    plan = mixing.rates(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---------------------------------------------------------------- 3
PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header>
<div class="cookie-notice"><p>We use cookies. Accept, please.</p></div><nav>a b<ul><li><a href=x>Home</a><li><a>About</a></ul></nav>
<div id=content><main><article><h1>The &lt;title&gt; &amp co</h1><p>First par, with&nbsp;text.<p>Second <i>par</i>ts<ul><li>item one, long enough. Yes</li>
<li>item two.</ul><form><input name=q>Search <button>Go</button></form><div class="ad-slot">Buy now, cheap!</div>
<section id="comments"><h3>Comments</h3><article class="comment"><p>Nice text, I liked it a lot. Really.</p></article></section></article></main></div>
<aside><p>Sidebar, with long text. It has sentences, and more. And more.</p></aside><footer>&copy; 2020</footer><script>if(a<b){}</script></body>"""


def test_html_page():
    assert html_main.main_text(PAGE) == ("The <title> & co\nFirst par, with text.\nSecond parts\nitem one, long enough. Yes\nitem two.")


def test_html_without_article():
    page = ("<html><body><div class=top><a href=/>Home</a> <a href=/a>About us</a></div><table><tr><td><a>x</a><br><a>y</a></td><td><div class=story>"
            "<h1>Headline here</h1><p>Long paragraph number one, with text; and punctuation. Another sentence follows, as expected.</p>"
            "<p>Para two is long as well, with many words. It goes on, and on.</p></div></td></tr></table></body></html>")
    assert html_main.main_text(page).split("\n")[0] == "Headline here" and "Home" not in html_main.main_text(page)


LINE = "A paragraph with some words, and a few more; it has its own end here, about one hundred characters."
PARTS = [f"<pre>{'x = f(1, 2); ' * 4600}</pre>", f"<p>{'Long text, on and on. ' * 50_000}</p>", "<ul><li>twelve chars</li><li>no</li></ul>",
         "<table><tr><td>ab</td><td>12</td></tr></table>", "<dl><dt>a</dt><dd>b</dd></dl>", "<blockquote>short</blockquote>"]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><section>{}</section></main>", "<div class=story>{}</div>"])
def test_html_keeps_whole_text(part, frame):
    """Neither a very long block nor short items beside paragraphs cost any text of the page."""
    inner = f"<p>{LINE}</p>" * 40 + part
    page = "<html><body><nav><a>Home</a></nav><div class=top><a href=/>Start</a></div>" + frame.format(inner) + "<footer>end</footer></body></html>"
    import re
    want = [" ".join(x.split()) for x in re.split("<[^>]*>", inner)]
    assert html_main.main_text(page) == "\n".join(x for x in want if x)


def test_html_long_paragraphs_beside_short_ones():
    page = f"<article><p>{'word, ' * 100}</p><h2>Part</h2><table><tr><td>ab</td></tr></table><ul><li>twelve chars</li></ul><p class=x>end</p></article>"
    assert html_main.main_text(page).split("\n")[1:] == ["Part", "ab", "twelve chars", "end"]


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>a <b", "a"), ("plain", "plain"), ("<script>x</script>", ""), ("<!-- open", ""),
                                       ("<nav>x</nav>", ""), ("<p>&am &lt;</p>", "&am <"), ("<article><nav><a>m</a></article>", "")])
def test_html_odd(page, text):
    assert html_main.main_text(page) == text


def test_html_real(spark):
    """On pages with one article: the blocks of that article, found by splitting at its tags."""
    import html
    import re
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_main.extract(pages).collect()
    assert len(rows) == len(raw)
    for r in rows:
        inner = re.search("<article>(.*)</article>", raw[r["page_id"]], re.S)[1].replace("<br>", " ").replace("<b>", "")
        want = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


# ---------------------------------------------------------------- 4
def check_edited(df):
    rows = sorted(((i, t or "") for i, t in pairs(df)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9),
                   round(r["near_next"], 9)) for r in merkle.edited_fingerprints(df).collect())
    tree = lambda t: merkle._trees_of([t])[0].text
    want = Counter()
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        e = t[:len(t) - k] + u[:k]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), tree(t), tree(e), round(merkle.likeness(tree(t), tree(e)), 9),
              round(merkle.likeness(tree(t), tree(u)), 9))] += 1
    assert got == want


def test_fingerprints(docs, odd, none):
    check_edited(docs)
    check_edited(odd)
    assert merkle.edited_fingerprints(none).collect() == []
    assert merkle.fingerprints(odd).count() == len(ODD)


def test_fingerprint_locates_edit():
    lines = [f"line {i} has some words of its own, number {i * i}" for i in range(60)]
    a = merkle._trees_of(["\n".join(lines)])[0].text
    lines[40] = "quite another line"
    b = merkle._trees_of(["\n".join(lines)])[0].text
    found = merkle.differences(a, b)
    assert len(found) == 1 and merkle.differences(a, a) == [] and 0.9 < merkle.likeness(a, b) < 1 == merkle.likeness(a, a)


# ---------------------------------------------------------------- 5
def check_neighbours(df, k=20, every=20):
    got = {}
    for r in mih.search(df, k, every).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"]]
    rows = [(i, x) for i, x in rows if all(v is not None and np.isfinite(v) for v in x) and any(x)]
    ids, x = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    hits = total = 0
    for j in np.flatnonzero(ids % every == 0):
        s = x @ x[j]
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if i != j][:k]
        g = sorted(got[int(ids[j])])
        assert [r for r, _, _ in g] == list(range(1, len(want) + 1))
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(g, g[1:]))
        assert all(abs(c - s[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, c in g)
        hits, total = hits + len(set(want) & {v for _, v, _ in g}), total + len(want)
    return hits / max(total, 1)


def test_neighbours_recall(spark):
    assert check_neighbours(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")) >= 0.9


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (21, None), (22, [0.0, 0.0]), (23, [float("nan"), 1.0]), (40, [3.0, -1.0]), (41, [1.0, None])]
    schema = "vec_id long, embedding array<float>"
    assert check_neighbours(spark.createDataFrame(rows + [(100 + i, [1.0, 2.0]) for i in range(40)], schema)) == 1
    assert check_neighbours(spark.createDataFrame(rows, schema)) == 1
    assert mih.search(spark.createDataFrame([], schema)).collect() == []


def test_index_retrieves_every_code_in_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, 400).astype(np.uint64)
    index = mih.Index(codes)
    for radius in (0, 7, 8, 20, 30, 64):
        q = codes[3] ^ np.uint64(0b1011)
        assert (index.within(q, radius) == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius)).all()


# ---------------------------------------------------------------- 6
@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, percent):
    got = {r[0]: (r[1], r[2]) for r in jaccard_rtree.ngram_components(docs, k, percent).collect()}
    assert got == brute.jaccard_components(pairs(docs), k, percent)


def test_jaccard_near_copies(spark):
    """Groups of near copies, chains and pairs just around the threshold; lists forced into blocks."""
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 160))]
        for _ in range(rnd.randint(1, 25)):
            w = list(base)
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((n, " ".join(w).title() if rnd.random() < 0.2 else " ".join(w)))
            n += 1
            base = w if rnd.random() < 0.3 else base
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard_components(rows, 4, 85)
    old = jaccard_rtree.LIST_ROWS, jaccard_rtree.LEADERS
    try:
        for jaccard_rtree.LIST_ROWS, jaccard_rtree.LEADERS in ((20_000, 4), (3, 1)):
            assert {r[0]: (r[1], r[2]) for r in jaccard_rtree.ngram_components(df, 4, 85).collect()} == want
    finally:
        jaccard_rtree.LIST_ROWS, jaccard_rtree.LEADERS = old


def test_jaccard_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    r = np.random.default_rng(5)
    words, rows = [f"w{x}" for x in r.integers(0, 4000, 150)], []
    for i in range(1000):
        t = list(words)
        for at in r.integers(0, 150, int(r.integers(0, 10))):
            t[at] = f"e{r.integers(0, 10**6)}"
        rows.append((i, " ".join(t)))
    compared = []
    verified = jaccard_rtree._verified
    monkeypatch.setattr(jaccard_rtree, "_verified", lambda src, pairs, k, percent: compared.append(pairs.count()) or verified(src, pairs, k, percent))
    got = jaccard_rtree.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute.jaccard_components(rows, 5, 80)
    assert sum(compared) < 2 * len(rows)  # 12,081 when every pair across components was listed


@pytest.mark.parametrize("nodes, edges", [(1, 3), (8, 12), (40, 300), (300, 200)])
def test_spanning_forest(nodes, edges):
    r = np.random.default_rng(nodes)
    u, v = r.integers(0, nodes, (2, edges))
    label, want = np.arange(nodes), []
    for a, b in zip(u, v, strict=True):  # best first
        want.append(label[a] != label[b])
        label[label == label[a]] = label[b]
    assert jaccard_rtree.spanning_forest(u, v, nodes).tolist() == want


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(1)
    vec = rng.poisson(2, (300, 16)) + np.repeat(rng.integers(0, 4, (30, 16)), 10, axis=0)
    size = vec.sum(axis=1)
    got = {tuple(sorted(p)) for i, j in jaccard_rtree.CountTree(vec, size).pairs(85) for p in zip(i.tolist(), j.tolist())}
    bound = np.minimum(vec[:, None], vec[None]).sum(axis=2)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bound[i, j] * 185 >= 85 * (size[i] + size[j])}
    assert got == want


def test_jaccard_odd(odd, none):
    got = {(r[0], r[1], r[2]) for r in jaccard_rtree.ngram_components(odd, 4, 85).collect()}
    assert {(1, 0, 1), (2, 0, 2), (7, 0, 7), (None, None, None), (4, 3, 4), (5, 3, 4), (8, 19997, 8), (9, 19998, 8)} <= got
    assert jaccard_rtree.ngram_components(none, 4, 85).collect() == []
    left = jaccard_rtree.one_per_component(odd)
    assert left.columns == odd.columns
    ids = sorted(str(r[0]) for r in left.collect())
    assert ids == sorted(str(i) for i in (1, 2, 3, 4, None, 7, 8, 10, 11))


# ---------------------------------------------------------------- 7
def check_packed(df, capacity=2048):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in pairs(df):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = packing.pack(df, capacity=capacity).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(x[3] * n for x, n in want.items()) // capacity)


def test_packing_real(docs):
    used, least = check_packed(docs)
    assert used <= least + max(1, least // 50)


def test_packing_odd(odd, none):
    check_packed(odd)
    check_packed(odd, capacity=64)
    assert packing.pack(none).collect() == []


def test_search_improves_best_fit():
    rnd = random.Random(1)
    for lo, hi in ((300, 1100), (1, 2048), (500, 700)):
        sizes = Counter(rnd.randint(lo, hi) for _ in range(3000))
        bins = packing.plan_bins(sizes, 2048)
        held = Counter()
        for pattern, k in bins:
            assert sum(pattern) <= 2048
            for x in pattern:
                held[x] += k
        assert held == sizes and sum(k for _, k in bins) <= sum(k for _, k in packing.plan_bins(sizes, 2048, steps=0))


def test_special_strings_are_encoded_alike(spark):
    check_packed(spark.createDataFrame([(1, "<|endoftext|> a<|endoftext|>"), (2, "ÿ\u00a0  \r\n\t x"), (3, "œ<|endoftext|>")], "doc_id long, text string"))


# ---------------------------------------------------------------- 8
def test_language_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    for context in (" th", "ent", "zzz"):  # probabilities over the seen symbols sum to at most 1
        head = np.uint64(0)
        for c in context:
            head = (head << np.uint64(16)) | np.uint64(ord(c))
        al = np.arange(65536, dtype=np.uint64)
        seen = al[model._find(langid._hash(al, 1)) >= 0]
        mass = np.exp(model.log_p((head << np.uint64(16)) | seen)).sum(axis=0)
        assert (mass > 0.9).all() and (mass < 1.001).all()
    r = langid.identify(docs, model).where((F.crc32(F.col("doc_id").cast("string")) % 3) == 1)
    ok, n, rejected = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert ok >= 0.97 and n > 200 and rejected <= 2


def test_language_rejects_what_it_does_not_know(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rnd = random.Random(0)
    alien = ["".join(rnd.choice("qxzjkwv") for _ in range(400)), "これは日本語の文章です。" * 20, "12345 ... !!", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(alien)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(rows, model).collect()}
    assert all(r["rejected"] for r in got.values())
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and got[4]["score"] == 0


def test_language_models_learn_from_every_training_row(spark, monkeypatch):
    """Every n-gram of every training row is in the models, and the limits come from every training row."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join([letters[i % 26] + letters[i // 26] + letters[(i * 7) % 26]] * 20), "xy"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    seen, plain = [], langid.identify
    monkeypatch.setattr(langid, "identify", lambda d, *more: (seen.append(d.count()), plain(d, *more))[1])
    model = langid.fit(docs)
    assert sum(seen) == len(train) and set(model.limits) <= {"x", "y"} and model.limits
    for _, text, _ in train:
        data, off = texts_of(pa.array([text]))
        assert (model._find(langid._hash(langid._grams(*langid.symbols(data, off)), langid.ORDER)) >= 0).all()


def plain_kneser_ney(texts):
    """(language, 4 symbols) -> log-probability of the last one, from the texts of each language; every n-gram counts."""
    counts = {}
    for lang, some in texts.items():
        own = Counter()
        for t in some:
            t = "   " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + (" " if t[-1:] and not t[-1].isalpha() else "")
            own.update(t[i:i + 4] for i in range(len(t) - 3))
        chain = [own]
        for k in (3, 2, 1):
            chain.insert(0, Counter(g[-k:] for g in chain[0]))
        counts[lang] = chain
    floor = 1 / (len(set().union(*[c[0] for c in counts.values()])) + 1)
    totals = {lang: [(Counter(), Counter()) for _ in range(4)] for lang in counts}
    for lang, chain in counts.items():
        for k, level in enumerate(chain):
            for g, n in level.items():
                totals[lang][k][0][g[:-1]] += n
                totals[lang][k][1][g[:-1]] += 1

    def log_p(lang, gram):
        p = floor
        for k, level in enumerate(counts[lang]):
            one, two = (sum(n == m for n in level.values()) for m in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.5
            g = gram[-k - 1:]
            if total := totals[lang][k][0][g[:-1]]:
                p = max(level[g] - d, 0) / total + d * totals[lang][k][1][g[:-1]] / total * p
        return np.log(p)
    return counts, log_p


def as_grams(grams):
    return np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)


def test_language_models_keep_every_gram_of_many_languages(spark):
    """70 languages with more than 1,000 n-grams each: all are in the models, with the probabilities of plain Kneser-Ney."""
    rnd = random.Random(3)
    rows = []
    for i in range(70):
        letters = "".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 12))
        rows += [(100 * i + j, " ".join("".join(rnd.choice(letters) for _ in range(9)) for _ in range(40)), f"l{i:02d}") for j in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            texts.setdefault(lang, []).append(t)
    counts, log_p = plain_kneser_ney(texts)
    assert model.langs == sorted(texts) and max(len(c[3]) for c in counts.values()) > 1300
    for c in counts.values():
        assert (model._find(langid._hash(as_grams(c[3]), langid.ORDER)) >= 0).all()
    some = [g for lang in ("l00", "l41") for g in rnd.sample(sorted(counts[lang][3]), 30)] + ["zzzz", " qqz", "abé "]
    got = model.log_p(as_grams(some))
    for lang in ("l00", "l07", "l41"):
        want = np.array([log_p(lang, g) for g in some])
        assert np.abs(got[:, model.langs.index(lang)] - want).max() < 1e-4


def test_language_models_in_files(spark, monkeypatch):
    """Models beyond what is taken at once, and few numbers kept by a worker, give the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda: sorted(map(tuple, langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).collect()))
    want = rows()
    monkeypatch.setattr(langid, "PART", 2000)
    monkeypatch.setattr(langid, "KEPT", 1)
    monkeypatch.setattr(langid, "BLOCK", 100)
    assert rows() == want and any(r[2] != "und" for r in want)


def test_language_odd(odd, none):
    model = langid.fit(odd)
    got = langid.identify(odd, model)
    assert got.count() == len(ODD) and got.columns[:5] == odd.columns[:5]
    assert langid.accepted(odd).columns == odd.columns
    assert langid.accepted(none).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}


# ---------------------------------------------------------------- 9
def test_chat_escapes_are_reversible():
    rnd = random.Random(0)
    parts = ["<", "|", ">", "/", "s", "[INST]", "[/INST]", "</s>", "\\", "\\\\", "<|", "|>", "<|end|>", "a", "\n", "<<SYS>>", "", "turn:", "<|turn:"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        role = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
        out = chat.render([{"role": role, "text": t}] * 2)
        assert chat.read_back(out) == [(role, t)] * 2


def test_chat_detects_rewriting():
    turns = [{"role": "user", "text": str(i)} for i in range(200)]
    assert "".join(chat.turn_spans(iter(turns))) == chat.render(turns)
    with pytest.raises(chat.HistoryRewritten):
        list(chat.turn_spans(iter(turns), lambda m: f"{len(m)} turns" + chat.render(m)))
    with pytest.raises(chat.HistoryRewritten):  # the first turn's thoughts are dropped once there is a second
        list(chat.turn_spans(iter(turns), lambda m: "".join(x["text"] + ("!" if i == len(m) - 1 else "") for i, x in enumerate(m))))
    with pytest.raises(chat.HistoryRewritten):  # depends on all of history
        list(chat.turn_spans(iter(turns), lambda m: "".join(f"{i}:{x['text']};" for i, x in enumerate(m))))


def check_chat(df):
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    convs = {}
    for r in df.collect():
        convs.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(convs)
    for i, rows in convs.items():
        rows.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] is not None, r["role"] or "", r["text"] is not None, r["text"] or ""))
        turns = "".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in rows)
        loss = "".join(r["text"] or "" for r in rows if r["role"] == "assistant")
        g = got[i]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (
            len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["formatted_chars"] == len(chat.render([{"role": r["role"] or "", "text": r["text"] or ""} for r in rows]))


def test_chat_tables(spark):
    check_chat(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "a\nb"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(2, i, "assistant" if i % 2 else "user", "t" * (i % 7)) for i in range(300)]
    check_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    spans = chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert spans.count() == len(rows)


# ---------------------------------------------------------------- 10
def test_url_rules(spark):
    rules = urlfilter.rule_table(spark, queries.URL_RULES)
    urls = {"http://a.net/x": ("a.net", "/x", "net/", "block"), "HTTP://WWW.Example.NET/en/a?b#c": ("www.example.net", "/en/a", "example.net/en/", "allow"),
            "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
            "x://a.org/fr/1": ("a.org", "/fr/1", "org/fr/", "allow"), "http://a.net": ("a.net", "", None, "allow"), "nothing": ("", "", None, "allow"),
            "http://net?x": ("net", "", None, "allow"), "http://net/#/en/": ("net", "/", "net/", "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
            "http:///en/": ("", "/en/", None, "allow"), "a://b://net/": ("b:", "//net/", None, "allow")}
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    rows = urlfilter.judge(df, rules).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]], r
    assert urlfilter.judge(df.limit(0), rules).collect() == []


def test_url_rule_within_a_word(spark):
    rules = urlfilter.rule_table(spark, [("block", "a.b", "/pre"), ("allow", "b", "/prefix")])
    df = spark.createDataFrame([(1, "http://x.a.b/prefixed"), (2, "http://a.b/prey")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urlfilter.judge(df, rules).collect()} == {1: "b/prefix", 2: "a.b/pre"}


# ---------------------------------------------------------------- kernels
def test_shingles_match_brute(docs):
    from precis.llm.common import texts_of
    import pyarrow as pa
    texts = [t for _, t in pairs(docs)] + [t for _, t in ODD]
    data, off = texts_of(pa.array(texts, pa.string()))
    for t, s in zip(texts, kernels.shingle_hashes(data, off, 4), strict=True):
        assert len(brute.shingles(t, 4)) == len(s)


def test_sliding():
    x = np.random.default_rng(0).integers(0, 2**31, 999, dtype=np.uint32)
    for w in (1, 2, 3, 64, 361):
        assert kernels.sliding_min(x, w).tolist() == [x[i:i + w].min() for i in range(len(x) - w + 1)]

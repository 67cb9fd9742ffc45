"""Mixing sources to target weights by soft membership (operator 2).

Domains are the label combinations that ``targets`` names (for the ``labels``
table ``quality`` and ``toxic``: ``q1_t0`` and so on).  A naive Bayes classifier over
word and shape features, learned from labelled documents, with a prior fitted to
their shares, gives every document a posterior over the domains.  Every document then gets a rate: nonnegative
rates r, found from 1 by projected gradient descent, whose expected token totals per domain,
``sum(r * tokens * posterior)``, match the targets, or come as near as the bounds on rates let them.  An
iteration is one or two distributed aggregates of K * K numbers.

Everything is DataFrame and SQL functions.  The classifier and its prior are learned
from all labelled documents; broadcast are only the features' weights (``FEATURES`` rows).

Defined results: null or empty text has no tokens, the posterior of its shape
and the rate that follows from it; repeated rows have equal rates; a document
that is labelled more than once counts once per label row; without labelled
documents of a domain its posterior is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import written

__all__ = ["TARGETS", "domain_of", "feature_weights", "posteriors", "fit_rates", "mix", "apply_rates"]

#: Shares of the mix by domain (quality, toxic); what is not named is not wanted.
TARGETS = {"q1_t0": 0.95, "q0_t0": 0.03, "q1_t1": 0.015, "q0_t1": 0.005}
#: Features that the classifier keeps, documents a feature must be in.
FEATURES, LEAST = 4096, 5
#: Weight of the prior in a feature's ratio; a word is used if its largest log ratio and its G statistic (twice the
#: log likelihood that the domains explain) reach these.
STRENGTH, TELLING, SURE = 10.0, 1.0, 20.0
#: Runs of symbols and of capitals, counted against the words.
SYMBOLS, CAPITALS = r"[%&*$#!|@^~=+<>{}\[\]\\]+", r"\p{Lu}{2,}"
#: Steps (an aggregate each) and tolerance of the prior's fit, and the largest move of a step.
PRIOR_STEPS, PRIOR_TOLERANCE, PRIOR_MOVE = 40, 1e-3, 2.0
#: Share of the mix from which a domain limits the budget when rates are limited.
LEADING = 0.5
#: Gradient steps at most, steps between two written tables, the relative error of a domain, the distance from the least
#: error (a share of the first), the share of an error that is left after five steps, and the movement of the rates that end them.
STEPS, CHAIN, TOLERANCE, GAP, SLOW, STILL = 60, 2, 1e-3, 2e-3, 0.5, 1e-4


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.concat(F.lit("q"), F.col(quality).cast("string"), F.lit("_t"), F.col(toxic).cast("string"))


def _key(text: str, doc_id: str) -> Column:
    """128 bits of a row's id and text; a null and an empty value are the same here."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string"))))


def _featured(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_key, doc_id, n_tokens and features: distinct lower-cased words and marked shape features."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\s+"), "")
    d = docs.select(_key(text, doc_id).alias("_key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"),
                    words.alias("_w"))
    d = d.select("_key", "doc_id", "_t", F.size("_w").cast("bigint").alias("n_tokens"), F.array_distinct("_w").alias("_d"))
    size = F.length("_t")
    share = lambda a, b, steps: F.floor(steps * a / F.greatest(b, F.lit(1)))
    shape = F.array(
        F.lit("\u0001bias"),
        F.concat(F.lit("\u0001new="), share(F.size("_d"), F.col("n_tokens"), 10).cast("string")),
        F.concat(F.lit("\u0001symbols="), F.least(share(F.regexp_count("_t", F.lit(SYMBOLS)), F.col("n_tokens"), 10), F.lit(10)).cast("string")),
        F.concat(F.lit("\u0001capitals="), F.least(share(F.regexp_count("_t", F.lit(CAPITALS)), F.col("n_tokens"), 10), F.lit(10)).cast("string")),
        F.concat(F.lit("\u0001words="), F.floor(F.log2(F.col("n_tokens") + 1)).cast("string")),
        F.concat(F.lit("\u0001mean="), F.least(F.floor(size / F.greatest("n_tokens", F.lit(1))), F.lit(20)).cast("string")))
    return d.select("_key", "doc_id", "n_tokens", F.concat("_d", shape).alias("features"))


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and one row per feature.  Arrays are never empty; a plain explode would have Spark test that first, on
    the text, with all features made once more."""
    return rows.select(*columns, F.explode_outer("features").alias("feature"))


def _labelled(labels: DataFrame, domains: list[str], domain: Column, doc_id: str) -> DataFrame:
    """(doc_id, domain) of the labels that name one of the domains."""
    return labels.select(F.col(doc_id).alias("doc_id"), domain.alias("domain")).where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())


def _few(docs: DataFrame, lab: DataFrame, doc_id: str) -> DataFrame:
    """Labelled documents; labels grow with the documents, so a broadcast would serve small tables only."""
    return docs.join(lab.select(F.col("doc_id").alias(doc_id)).distinct().hint("merge"), doc_id, "left_semi")


def _learned(docs: DataFrame, lab: DataFrame, domains: list[str], text: str, doc_id: str) -> tuple[DataFrame, list[int], list[float]]:
    """(feature, w: log-likelihood ratio per domain) without the prior, labelled rows per domain and the log prior."""
    seen = _each(_featured(_few(docs, lab, doc_id), text, doc_id).join(lab.hint("merge"), "doc_id"), "domain")
    n = seen.groupBy("feature").agg(*[F.sum((F.col("domain") == k).cast("bigint")).alias(f"n{i}") for i, k in enumerate(domains)])
    n = written(n.where(sum(F.col(f"n{i}") for i in range(len(domains))) >= LEAST), "features")
    total = n.where(F.col("feature") == "\u0001bias").first()  # one row
    size = [int(total[f"n{i}"]) if total else 0 for i in range(len(domains))]
    everything = max(sum(size), 1)
    among = sum(F.col(f"n{i}") for i in range(len(domains)))
    # P(domain | feature) / P(domain), drawn towards 1 as if STRENGTH more documents had the feature in all domains alike
    share_of = [(x + 0.5) / (everything + 0.5 * len(size)) for x in size]
    ratio = [F.log((F.col(f"n{i}") + STRENGTH * q) / (among + STRENGTH) / q) for i, q in enumerate(share_of)]
    # the whole signed ratio counts; a word is only chosen if it points to a domain, as weak words come with a language or
    # a length, and they are many and come together
    explained = 2 * sum(F.when(F.col(f"n{i}") > 0, F.col(f"n{i}") * F.log(F.col(f"n{i}") * everything / (among * max(x, 1)))).otherwise(0.0)
                        for i, x in enumerate(size))
    shape = F.col("feature").startswith("\u0001")
    far = F.greatest(*ratio, F.lit(0.0))
    top = n.where((F.col("feature") != "\u0001bias") & (shape | (far >= TELLING) & (explained >= SURE)))
    top = top.orderBy(F.desc(shape), F.desc(explained), "feature").limit(FEATURES)
    weights = written(top.select("feature", F.array(*ratio).alias("w")), "features")
    return weights, size, [math.log(q) if x else -1e9 for x, q in zip(size, share_of, strict=True)]


def _with_prior(weights: DataFrame, prior: list[float]) -> DataFrame:
    return weights.unionByName(weights.sparkSession.createDataFrame([("\u0001bias", [float(x) for x in prior])], "feature string, w array<double>"))


def _prior_moves(labelled: DataFrame, size: list[int]) -> np.ndarray:
    """What to add to the log prior so that the mean posterior of the labelled rows (rows, p) is the share of each domain
    among them: features that come together are counted several times, and the prior makes up for it.

    Newton steps on a convex function; each is one aggregate of 2 + K + K^2 numbers.  One that does not lower it is
    undone, and the plain step (the logs of the ratios, which never raises it) is made instead."""
    k, everything = len(size), sum(size)
    moved = np.zeros(k)
    if not everything:
        return moved
    found = np.array(size) / everything
    some = found > 0

    def measured(at: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        e = [F.col("p")[i] * float(x) for i, x in enumerate(np.exp(at))]
        whole, rows = sum(e), F.col("rows").cast("double")
        now = [x / whole for x in e]
        got = labelled.agg(F.sum(rows), F.sum(rows * F.log(whole)), *[F.sum(rows * x) for x in now],
                           *[F.sum(rows * x * y) for x in now for y in now]).first()
        got = np.array([float(x or 0) for x in got])
        many = max(got[0], 1e-9)
        return got[0], got[1] / many - float(at @ found), got[2:2 + k] / many, got[2 + k:].reshape(k, k) / many

    rows, height, mean, both = measured(moved)
    for _ in range(PRIOR_STEPS if rows else 0):
        if (np.abs(mean - found) <= PRIOR_TOLERANCE * found).all():
            break
        plain = np.where(some, np.log(np.maximum(found, 1e-9) / np.maximum(mean, 1e-9)), 0.0)
        step = np.linalg.pinv(np.diag(mean) - both, rcond=1e-9, hermitian=True) @ (found - mean)
        step = np.where(some, step, 0.0) * min(1.0, PRIOR_MOVE / max(np.abs(step).max(), 1e-9))
        there = measured(moved + step)
        if there[1] > height + 1e-12:
            step, there = plain, measured(moved + plain)
        moved = moved + step
        _, height, mean, both = there
    return moved


def feature_weights(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """(feature, w: log-likelihood ratio per domain) from all labelled documents; the feature ``bias`` holds the fitted log prior."""
    lab = _labelled(labels, domains, domain, doc_id)
    weights, size, prior = _learned(docs, lab, domains, text, doc_id)
    scored = posteriors(_few(docs, lab, doc_id), _with_prior(weights, prior), len(size), text, doc_id)
    moved = _prior_moves(written(scored.join(lab, "doc_id").select("rows", "p"), "labelled"), size)
    return _with_prior(weights, [a + m for a, m in zip(prior, moved.tolist(), strict=True)])


def posteriors(docs: DataFrame, weights: DataFrame, k: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_key, doc_id, n_tokens, rows (equal rows) and p: the posterior over the domains."""
    f = _each(_featured(docs, text, doc_id), "_key", "doc_id", "n_tokens")
    hit = f.join(F.broadcast(weights), "feature")
    sums = hit.groupBy("_key", "doc_id", "n_tokens").agg(
        F.sum((F.col("feature") == "\u0001bias").cast("bigint")).alias("rows"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    s = [F.col(f"s{i}") / F.col("rows") for i in range(k)]
    top = F.greatest(*s) if k > 1 else s[0]
    e = [F.exp(x - top) for x in s]
    return sums.select("_key", "doc_id", "n_tokens", "rows", F.array(*[x / sum(e) for x in e]).alias("p"))


def fit_rates(members: DataFrame, shares: list[float], budget: float | None = None, most: float | None = None,
              trace: list[float] | None = None) -> DataFrame:
    """``members`` with rate: accelerated projected gradient descent, from rate 1, on the squared error of the domains' expected
    tokens, measured in the inverse of their overlap (the tokens that two domains share in all rows).

    In that measure a step of length 1 is 1 / L: whatever bounds hold, it does not raise the error, and without bounds it ends
    at the rates nearest to 1 that meet the targets.  Steps carry momentum; one that raises the error is undone and the momentum
    dropped.  Now and then a longer step is tried, by the overlap of the rows whose rate can still move, and taken if it
    halves the error.  The descent ends when all targets are met, when the error is within GAP (a share of the
    first error) of the least that the bounds allow, as the duality gap shows, or when a step moves the rates (root of the mean
    square by tokens) less than STILL or five steps leave more than SLOW of the error; a warning says so if STEPS came first.  ``trace`` collects the error after each step.

    ``budget``: tokens of the mix; by default the most that needs no domain to be repeated.  ``most``: largest rate allowed;
    the default budget is then set by the domains of at least LEADING of the mix, and a scarcer one gives all it has."""
    k = len(shares)
    tokens = F.col("rows") * F.col("n_tokens")
    rate, start = F.col("rate"), F.col("start")
    free = (rate > 0) if most is None else (rate > 0) & (rate < most)
    pairs = [tokens * F.col("p")[i] * F.col("p")[j] for i in range(k) for j in range(k)]
    totals = [F.sum(tokens * rate * F.col("p")[i]) for i in range(k)] + [F.sum(F.when(free, x)) for x in pairs]

    def measured(d: DataFrame, *more: Column) -> tuple:
        found = [float(x or 0) for x in d.agg(*totals, *more).first()]  # K + K * K numbers, and a few
        return np.array(found[:k]), np.array(found[k:k + k * k]).reshape(k, k), found[k + k * k:]

    # rate: now; ahead: where the next step starts from
    m = written(members.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0)), "rates")
    have, overlap, rest = measured(m, F.sum(tokens), *[F.sum(x) for x in pairs])
    every, whole = max(rest[0], 1e-9), np.array(rest[1:]).reshape(k, k)
    inverse = np.linalg.pinv(whole, rcond=1e-9, hermitian=True)
    if budget is None:
        least = 0.0 if most is None else min(LEADING, max(shares, default=0.0))
        budget = min([h / s * (1.0 if most is None else most) for h, s in zip(have, shares, strict=True) if s > 0 and s >= least and h > 0], default=0.0)
    want = np.array([budget * s if h > 0 else 0.0 for h, s in zip(have, shares, strict=True)])
    if most is not None:
        want = np.minimum(want, most * have)

    def size(now) -> float:
        return float((now - want) @ inverse @ (now - want))

    def slope(way: np.ndarray) -> Column:
        return sum(F.col("p")[i] * float(x) for i, x in enumerate(way))

    def bounded(c: Column) -> Column:
        c = F.greatest(F.lit(0.0), c)
        return c if most is None else F.least(c, F.lit(float(most)))

    now, ahead, f, t = have, have, size(have), 1.0
    wait, pause, settled = 0, 1, False
    record = [] if trace is None else trace
    record[:] = [f]
    for step in range(1, STEPS + 1):
        error = now - want
        slow = f <= 1e-6 * record[0] or len(record) > 5 and f > SLOW * record[-6]
        if slow or (np.abs(error) <= TOLERANCE * np.maximum(have, 1e-9)).all():
            settled = True
            break
        if step % CHAIN == 0:
            m = written(m, "rates")
        if wait == 0 and overlap.any() and not np.allclose(overlap, whole):
            far = m.withColumn("rate", bounded(rate - slope(np.linalg.pinv(overlap, rcond=1e-6, hermitian=True) @ error)))
            there, around, _ = measured(far)
            if size(there) <= 0.5 * f:
                m, now, overlap, f = far.withColumn("ahead", rate), there, around, size(there)
                ahead, t, pause = now, 1.0, 1
                record.append(f)
                continue
            wait, pause = pause, min(2 * pause, 16)
        else:
            wait = max(0, wait - 1)
        way = inverse @ (ahead - want)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / later
        went = m.withColumn("start", F.col("ahead")).withColumn("last", rate).withColumn("rate", bounded(F.col("ahead") - slope(way)))
        side = slope(way)
        gap = F.lit(None).cast("double") if most is None else F.when(side > 0, start * side).otherwise((start - float(most)) * side)
        there, around, (moved, over) = measured(went, F.sum(tokens * (rate - F.col("last")) * (rate - F.col("last"))), F.sum(2 * tokens * gap))
        if size(there) > f * (1 + 1e-12):
            m, ahead, t = m.withColumn("ahead", rate), now, 1.0
            continue
        m = went.withColumn("ahead", rate + F.lit(push) * (rate - F.col("last"))).drop("start", "last")
        ahead, now, overlap, f, t = there + push * (there - now), there, around, size(there), later
        record.append(f)
        if math.sqrt(max(moved, 0.0) / every) <= STILL or most is not None and over <= GAP * record[0]:
            settled = True
            break
    if not settled:
        warnings.warn(f"rates: {STEPS} steps did not settle; error {f:.3g}, at first {record[0]:.3g}", stacklevel=2)
    return m.drop("ahead")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domain: Column | None = None,
        budget: float | None = None, text: str = "text", doc_id: str = "doc_id", most: float | None = None) -> DataFrame:
    """Per distinct (id, text): _key, doc_id, n_tokens, rows, p (by domain in order of name) and rate."""
    domains = sorted(targets)
    total = sum(targets.values()) or 1.0
    lab = _labelled(labels, domains, domain_of() if domain is None else domain, doc_id)
    weights, size, prior = _learned(docs, lab, domains, text, doc_id)
    # every document is scored once; the prior is fitted to the labelled ones among them and then moves all posteriors
    members = written(posteriors(docs, _with_prior(weights, prior), len(domains), text, doc_id), "members")
    moved = np.exp(_prior_moves(written(members.join(lab, "doc_id").select("rows", "p"), "labelled"), size))
    e = [F.col("p")[i] * float(x) for i, x in enumerate(moved)]
    members = members.withColumn("p", F.array(*[x / sum(e) for x in e]))
    return fit_rates(members, [targets[x] / total for x in domains], budget, most)


def _copies() -> Column:
    """Whole copies of a row: the rate, its fraction settled by a hash of the row."""
    u = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("bigint")).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_tokens, the posterior of every domain, rate and copies."""
    m = mix(docs, labels, targets, text=text, doc_id=doc_id)
    return m.withColumn("copies", _copies()).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{x}") for i, x in enumerate(sorted(targets))], "rate", "copies")


def apply_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id",
                most: float | None = None) -> DataFrame:
    """``docs`` with every row as often as its rate (at most ``most``) says."""
    m = mix(docs, labels, targets, text=text, doc_id=doc_id, most=most)
    m = m.withColumn("n", _copies()).where("n > 0").select(F.col("_key").alias("__mix_key"), F.sequence(F.lit(1), F.col("n")).alias("__mix_copies"))
    both = docs.withColumn("__mix_key", _key(text, doc_id)).join(m, "__mix_key")
    return both.withColumn("__mix_copy", F.explode("__mix_copies")).select(docs.columns)

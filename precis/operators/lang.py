"""Language detection by character n-gram rank profiles.

Cavnar & Trenkle (1994): a language profile is its ``top`` most frequent
character 1..3-grams (words padded with '_'), ranked; a document is
assigned the language whose profile is nearest by the out-of-place measure
(sum over the document's top n-grams of |rank difference|, ``top`` when
absent).

Fitting counts distinct (language, word) pairs first, so every word is cut into
n-grams once per language and not once per occurrence.  Scoring is one pass
over the texts: n-grams are whole numbers (three code points of 21 bits, which
sort like the strings), a document's counts are one sort, and its ranks are
looked up in each language's sorted profile.  Profiles are languages x ``top``
rows; they are broadcast after a size check, and joined beyond it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.operators.topk import topk_per_group

__all__ = ["char_ngrams", "gram_codes", "top_codes", "fit_language_profiles", "shared_profiles", "with_language", "detect_language"]

#: Profile rows that are broadcast to the workers; more are joined.
PROFILE_ROWS = 1 << 20
N_MAX = 3
PAD, SPACE = ord("_"), ord(" ")


def _letters(text) -> Column:
    """Lower-case words with one space between."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[^\p{L}]+"), F.lit(" ")))


def char_ngrams(word, n_max: int = N_MAX) -> Column:
    """All 1..n_max character n-grams of one '_'-padded word."""
    p = F.concat(F.lit("_"), F.col(word) if isinstance(word, str) else word, F.lit("_"))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n_max)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, n))))


def gram_codes(words: str) -> np.ndarray:
    """The 1..3-grams of the '_'-padded words of a space-separated string, as numbers."""
    if not words:
        return np.zeros(0, np.int64)
    s = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    gap = s == SPACE
    p = np.repeat(s, 1 + gap)  # a space is the end of one word and the beginning of the next
    second = np.zeros(len(p), bool)
    second[np.cumsum(1 + gap)[gap] - 1] = True
    p[p == SPACE] = PAD
    p = np.concatenate([[PAD], p, [PAD]])
    word = np.concatenate([[0], np.cumsum(second), [int(second.sum())]])
    one = p << 42
    two = one[:-1] | p[1:] << 21
    out = [one, two[word[:-1] == word[1:]]]
    if len(p) > 2:
        out.append((two[:-1] | p[2:])[word[:-2] == word[2:]])
    return np.concatenate(out)


def top_codes(words: str, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams in rank order (count desc, then gram)."""
    codes, counts = np.unique(gram_codes(words), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:top]]


def _code(gram: str) -> int:
    c = [ord(x) for x in gram] + [0, 0]
    return c[0] << 42 | c[1] << 21 | c[2]


def fit_language_profiles(df: DataFrame, lang: str = "lang", text: str = "text", top: int = 300) -> DataFrame:
    """Language profiles from labelled text: (lang, gram, rank).  Words are
    counted per (lang, word) with map-side combine; the top-k cut is salted so
    a language holding most rows is still cut by many tasks."""
    words = df.select(F.col(lang).alias("lang"), F.explode(F.split(_letters(text), " ")).alias("word")).where(F.col("word") != "")
    w = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    g = w.select("lang", "n", F.explode(char_ngrams("word")).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("cnt"))
    t = topk_per_group(g, ["lang"], [F.desc("cnt"), F.asc("gram")], top, salt_by=["gram"], rank_col="rank")
    return t.select("lang", "gram", F.col("rank").cast("int").alias("rank"))


class _Profiles:
    """Per language: sorted gram codes and their ranks (from 0)."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        by: dict[str, list[tuple[int, int]]] = {}
        for lang, gram, rank in rows:
            by.setdefault(lang, []).append((_code(gram), rank - 1))
        self.sides = []
        for lang in sorted(by):
            pairs = sorted(by[lang])
            self.sides.append((lang, np.array([c for c, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)))

    def nearest(self, codes: np.ndarray, top: int) -> str | None:
        """The language with the least out-of-place distance (ties: by name) of those that share a gram."""
        best, rank = None, np.arange(len(codes))
        for lang, grams, ranks in self.sides:
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            hit = grams[at] == codes
            matched = int(hit.sum())
            if matched:
                dist = int(np.abs(rank[hit] - ranks[at[hit]]).sum()) + top * (len(codes) - matched)
                if best is None or dist < best[0]:
                    best = (dist, lang)
        return best[1] if best else None


def shared_profiles(profiles: DataFrame, profile_rows: int = PROFILE_ROWS) -> Broadcast | None:
    """The profiles for the workers, None if they are more than a worker should hold."""
    if profiles.limit(profile_rows + 1).count() > profile_rows:
        return None
    rows = [(r["lang"], r["gram"], r["rank"]) for r in profiles.select("lang", "gram", "rank").collect() if r["lang"] is not None]
    return profiles.sparkSession.sparkContext.broadcast(_Profiles(rows))


def with_language(df: DataFrame, sides: Broadcast, text: str = "text", top: int = 300, default: str = "en", out: str = "detected") -> DataFrame:
    """``df`` with the language of each row's text; no row moves."""
    @F.pandas_udf(T.StringType())
    def nearest(words: pd.Series) -> pd.Series:
        p = sides.value
        return pd.Series([p.nearest(top_codes(w, top), top) for w in words], dtype=object)

    return df.withColumn(out, F.coalesce(nearest(_letters(text)), F.lit(default)))


def detect_language(df: DataFrame, profiles: DataFrame, key: str = "id", text: str = "text", top: int = 300,
                    default: str = "en", out: str = "detected", profile_rows: int = PROFILE_ROWS) -> DataFrame:
    """(key, detected): nearest profile; text without letters -> ``default``."""
    sides = shared_profiles(profiles, profile_rows)
    if sides is None:
        return _detect_by_join(df, profiles, key, text, top, default, out)
    return with_language(df, sides, text, top, default, out).select(key, out)


def _detect_by_join(df: DataFrame, profiles: DataFrame, key: str, text: str, top: int, default: str, out: str) -> DataFrame:
    """The same for more profiles than a worker should hold: ranks are joined.  A language that shares no n-gram with a
    document has the largest distance there is, so only matched (document, language) rows exist."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ranked(words: pd.Series) -> pd.Series:
        return pd.Series([top_codes(w, top) for w in words], dtype=object)

    @F.pandas_udf(T.LongType())
    def code(grams: pd.Series) -> pd.Series:
        return grams.map(_code)

    t = df.select(key, ranked(_letters(text)).alias("_top"))
    doc = t.select(key, F.size("_top").alias("n"), F.posexplode("_top").alias("rank", "gram"))
    prof = profiles.where(F.col("lang").isNotNull()).select("lang", code("gram").alias("gram"), (F.col("rank") - 1).alias("lrank"))
    m = doc.join(prof, "gram").groupBy(key, "n", "lang").agg(
        F.sum(F.abs(F.col("rank") - F.col("lrank"))).alias("s"), F.count(F.lit(1)).alias("matched"))
    dist = m.select(key, "lang", (F.col("s") + F.lit(top) * (F.col("n") - F.col("matched"))).alias("dist"))
    best = dist.groupBy(key).agg(F.min_by("lang", F.struct("dist", "lang")).alias(out))
    return df.select(key).join(best, key, "left").select(key, F.coalesce(F.col(out), F.lit(default)).alias(out))

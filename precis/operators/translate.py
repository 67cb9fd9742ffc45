"""Language codes, translation memory and translation with retries
(C5, C6, C7, I23, I24, I25).

Translation itself is a plug-in: any ``translator(texts, src, tgt) ->
list[str]`` callable, run on executors in Arrow batches.  Only distinct
texts that the translation memory lacks reach it; a failing call is retried
``max_retries`` times with a pause and then falls back to the original text
with ``ok = false``.  Rows then meet the dictionary of distinct translations
in one join.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["LANGUAGES", "language_table", "language_code", "text_key", "translation_hits",
           "translation_misses", "translate_misses", "translation_dictionary", "translated_rows", "translate_cached",
           "to_english", "translate_to", "summarize_multilingual", "marker_translator"]

# The target languages offered and their codes.
LANGUAGES = [("English", "en"), ("Tamil", "ta"), ("Telugu", "te"), ("Hindi", "hi"),
             ("French", "fr"), ("Spanish", "es"), ("German", "de")]

#: Rows whose text keys are broadcast to pick out what a memory knows of them; of more the memory is joined whole.
BROADCAST_ROWS = 200_000
TM_SCHEMA = "key string, src string, tgt string, translated string"


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "name string, code string")


def language_code(df: DataFrame, name_col: str, out: str = "code") -> DataFrame:
    """Language name -> code (broadcast join with the 7-row table)."""
    t = F.broadcast(language_table(df.sparkSession).withColumnRenamed("name", name_col).withColumnRenamed("code", out))
    return df.join(t, name_col, "inner")


def text_key(text) -> F.Column:
    """Cache key of a text (SHA-256 of its UTF-8 bytes)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def translation_hits(df: DataFrame, tm: DataFrame) -> DataFrame:
    """Rows whose (text, src, tgt) is in the memory, with the cached text."""
    return df.join(tm, ["key", "src", "tgt"], "inner")


def translation_misses(df: DataFrame, tm: DataFrame) -> DataFrame:
    """Rows without a cached translation (left anti join)."""
    return df.join(tm.select("key", "src", "tgt"), ["key", "src", "tgt"], "left_anti")


def marker_translator(texts: list[str], src: str, tgt: str) -> list[str]:
    """A deterministic stand-in translator: tags the text with the language
    pair; refuses texts containing an ASCII digit (to exercise retries and
    the fallback)."""
    if any(re.search("[0-9]", t) for t in texts):
        raise RuntimeError("translation service unavailable")
    return [f"[{src}>{tgt}] {t}" for t in texts]


def translate_misses(misses: DataFrame, translator: Callable, max_retries: int = 3, pause: float = 1.5,
                     batch_size: int = 32) -> DataFrame:
    """(key, src, tgt, text) -> + translated, ok, attempts.  Batches are
    grouped by language pair; a failed batch is retried per row."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def attempt(texts, src, tgt):
            for a in range(1, max_retries + 1):
                try:
                    res = list(translator(texts, src, tgt))
                    if len(res) == len(texts):
                        return res, True, a
                except Exception:  # noqa: BLE001 — the service may fail
                    pass
                if a < max_retries and pause:
                    time.sleep(pause)
            return list(texts), False, max_retries

        for pdf in it:
            out = []
            for (src, tgt), g in pdf.groupby(["src", "tgt"], sort=False):
                for s in range(0, len(g), batch_size):
                    chunk = g.iloc[s:s + batch_size]
                    texts = chunk["text"].fillna("").tolist()
                    res, ok, n = attempt(texts, src, tgt)
                    if ok:
                        out.append(chunk.assign(translated=res, ok=True, attempts=n))
                        continue
                    for i in range(len(chunk)):   # isolate the failing rows
                        r, ok1, n1 = attempt(texts[i:i + 1], src, tgt)
                        out.append(chunk.iloc[i:i + 1].assign(translated=r, ok=ok1, attempts=n1))
            yield pd.concat(out) if out else pdf.assign(translated=pd.Series(dtype=str), ok=pd.Series(dtype=bool),
                                                       attempts=pd.Series(dtype="int32"))

    schema = T.StructType(list(misses.select("key", "src", "tgt", "text").schema.fields) + [
        T.StructField("translated", T.StringType()), T.StructField("ok", T.BooleanType()),
        T.StructField("attempts", T.IntegerType())])
    return misses.select("key", "src", "tgt", "text").mapInPandas(run, schema)


def translation_dictionary(df: DataFrame, text: str, src: str, tgt, tm: DataFrame, translator: Callable,
                           max_retries: int = 3, pause: float = 1.5, few: bool = False) -> DataFrame:
    """C6 + I25: (key, src, tgt, translated, cached, ok, attempts) of every distinct text that has to be translated.

    Copies of a text are one row before anything is joined; one left join with the memory tells hits from misses, and
    only misses reach the translator (attempts 0: a hit).  A text that fails keeps itself, with ``ok`` false.  ``few``: the
    keys are broadcast to the memory, which is usually larger, so that only what is known of them is shuffled."""
    tcol = F.lit(tgt) if isinstance(tgt, str) else tgt
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(src).alias("src"), tcol.alias("tgt"))
    need = rows.where(F.col("src") != F.col("tgt")).withColumn("key", text_key("text"))
    once = need.groupBy("key", "src", "tgt").agg(F.min("text").alias("text"))
    tm = tm.select("key", "src", "tgt", F.col("translated").alias("known"))
    if few:
        tm = tm.join(F.broadcast(need.select("key", "src", "tgt").distinct()), ["key", "src", "tgt"], "left_semi")
    known = once.join(tm, ["key", "src", "tgt"], "left")
    hits = known.where(F.col("known").isNotNull()).select("key", "src", "tgt", F.col("known").alias("translated"), F.lit(True).alias("cached"),
                                                          F.lit(True).alias("ok"), F.lit(0).alias("attempts"))
    done = translate_misses(known.where(F.col("known").isNull()), translator, max_retries, pause)
    return hits.unionByName(done.select("key", "src", "tgt", "translated", F.lit(False).alias("cached"), "ok", "attempts"))


def translated_rows(df: DataFrame, text: str, src: str, tgt, dictionary: DataFrame, key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, translated, cached, ok, attempts) and the columns ``keep``: every row by one join with the dictionary; text
    in the target language, and text that failed, stays as it is."""
    kept = [f"_keep{i}" for i in range(len(keep))]
    tcol = F.lit(tgt) if isinstance(tgt, str) else tgt
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.col(src).alias("src"), tcol.alias("tgt"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    plain = lambda d: d.select("_k", F.col("text").alias("translated"), F.lit(False).alias("cached"), F.lit(True).alias("ok"),
                               F.lit(0).alias("attempts"), *kept)
    need = rows.where(F.col("src") != F.col("tgt")).select("_k", text_key("text").alias("key"), "src", "tgt", *kept)
    done = need.join(dictionary, ["key", "src", "tgt"]).select("_k", "translated", "cached", "ok", "attempts", *kept)
    return done.unionByName(plain(rows.where(F.col("src") == F.col("tgt")))).withColumnsRenamed({"_k": key, **dict(zip(kept, keep))})


def translate_cached(df: DataFrame, text: str, src: str, tgt, tm: DataFrame, translator: Callable,
                     key: str = "id", max_retries: int = 3, pause: float = 1.5) -> DataFrame:
    """C6 + C7 + I25: (key, translated, cached, ok, attempts) — cache hits from ``tm``,
    distinct misses translated once, failures fall back to the original."""
    return translated_rows(df, text, src, tgt, translation_dictionary(df, text, src, tgt, tm, translator, max_retries, pause), key)


def to_english(df: DataFrame, text: str, lang: str, tm: DataFrame, translator: Callable, key: str = "id",
               **kw) -> DataFrame:
    """Translate only rows whose language is not English."""
    return translate_cached(df, text, lang, "en", tm, translator, key, **kw)


def translate_to(df: DataFrame, text: str, target: str, tm: DataFrame, translator: Callable, key: str = "id",
                 src_lang: str = "en", **kw) -> DataFrame:
    """Identity for 'en', else translate from ``src_lang``."""
    x = df.withColumn("_src", F.lit(src_lang))
    return translate_cached(x, text, "_src", target, tm, translator, key, **kw)


def _joined(df: DataFrame, key: str, left: Sequence[str], right: Sequence[str], again: DataFrame | None) -> DataFrame:
    """``df`` joined with itself by its key: (key, left, right).  Only rows whose key is ``again`` there have others to meet."""
    if again is None:
        return df.select(key, *left, *right)
    many = df.join(again, key, "left_semi")
    return df.join(again, key, "left_anti").select(key, *left, *right).unionByName(
        many.select(key, *left).join(many.select(key, *right), key).select(key, *left, *right))


def summarize_multilingual(df: DataFrame, profiles: DataFrame, tm: DataFrame, translator: Callable, key: str = "id",
                           text: str = "text", sentences: int = 3, pause: float = 1.5,
                           learned: Callable[[DataFrame], DataFrame] | None = None, sides: Broadcast | None = None,
                           used: list[str] | None = None) -> DataFrame:
    """(key, detected, summary_en, summary, ok): detect -> to English (memory + translator) -> lead summary -> back
    to the detected language.

    A row keeps its columns from step to step: texts move only to meet the dictionary of translations.  Rows with their
    language, and their summaries, are written once, as several steps read them.  Parts of rows of one key meet by the
    key, so rows of a key that comes several times meet each other; rows without a key are left out.

    ``learned`` is given each dictionary of translations (hits, fresh ones and failures), may store what is new in it,
    and returns the dictionary to be used; a written one keeps the translator from being asked again.  ``sides``: the
    profiles as ``shared_profiles`` gives them, if they are shared already.  The paths of written tables are added to
    ``used``; they may be dropped when the result has been read."""
    from precis.operators.lang import detect_language, shared_profiles, with_language
    from precis.operators.summarize import summarize_lead
    from precis.sources.files import handed_over
    keep, spark = learned or (lambda d: d), profiles.sparkSession

    def written(d: DataFrame, tag: str) -> DataFrame:
        table, path = handed_over(d, f"summarize/{tag}", spark)
        if used is not None:
            used.append(path)
        return table

    x = df.select(key, text).where(F.col(key).isNotNull())
    sides = sides or shared_profiles(profiles)
    x = written(x.join(detect_language(x, profiles, key, text), key) if sides is None else with_language(x, sides, text), "detected")
    n, most = x.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    again = x.groupBy(key).count().where("count > 1").select(key) if (most or 0) > 1 else None
    few = (n or 0) <= BROADCAST_ROWS
    if sides is not None:
        x = _joined(x, key, [text], ["detected"], again)
    there = keep(translation_dictionary(x, text, "detected", "en", tm.where(F.col("tgt") == "en"), translator, pause=pause, few=few))
    english = translated_rows(x, text, "detected", "en", there, key, ["detected"]).select(key, F.col("translated").alias("english"), "detected")
    back = summarize_lead(english, sentences, text="english", out="summary_en").withColumn("_en", F.lit("en")).select(
        key, "summary_en", "_en", "detected")
    back = _joined(written(back, "summaries"), key, ["summary_en", "_en"], ["detected"], again)
    home = keep(translation_dictionary(back, "summary_en", "_en", F.col("detected"), tm.where(F.col("src") == "en"), translator, pause=pause, few=few))
    out = translated_rows(back, "summary_en", "_en", F.col("detected"), home, key, ["detected", "summary_en"])
    return _joined(out.withColumnRenamed("translated", "summary"), key, ["detected", "summary_en"], ["summary", "ok"], again)

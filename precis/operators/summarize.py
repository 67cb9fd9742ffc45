"""Built-in summarizers (I14, I15) and the plug-in batch inference operator.

* ``summarize_lead`` — first n sentences; per row, no shuffle.
* ``summarize_frequency`` — SumBasic-style: a sentence scores the mean
  in-document frequency of its words; top-n sentences in document order.
* ``summarize_textrank`` — PageRank over the sentence graph whose edge
  weights are shared-word counts, computed through the sentence-word
  incidence (A A^T s as two sums), so sentence pairs are never
  materialised.  Both score a document inside its row: the JVM splits and
  cleans, one Arrow pass ranks, and no token is shuffled.
* ``summarize`` — pluggable model over whole tables via ``mapInPandas``,
  with per-row failure isolation (I20); ``summarize_loaded`` loads it once
  per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.functions.text import clean_text, join_tokens, sentences, whitespace_tokens
from precis.operators.rouge import rouge_tokens

__all__ = ["doc_sentences", "summarize_lead", "summarize_frequency", "summarize_textrank",
           "frequency_scores", "textrank_scores", "summarize", "summarize_loaded", "LoadOnce"]


def doc_sentences(df: DataFrame, text: str = "source", id_col: str = "id", clean: bool = True) -> DataFrame:
    """H10 -> posexplode: (id, sent_pos, sentence); narrow, no shuffle."""
    src = clean_text(F.col(text)) if clean else F.col(text)
    return df.select(F.col(id_col).alias("id"), F.posexplode(sentences(src, cleaned=clean)).alias("sent_pos", "sentence"))


def summarize_lead(df: DataFrame, n: int = 3, text: str = "source", out: str = "summary",
                   clean: bool = True) -> DataFrame:
    """I15 lead-n: the first n sentences joined by a space (per row)."""
    src = clean_text(F.col(text)) if clean else F.col(text)
    return df.withColumn(out, F.array_join(F.slice(sentences(src, cleaned=clean), 1, n), " "))


def _token_lines(sents) -> F.Column:
    """Scorer tokens of every sentence: one line per sentence, one space between tokens."""
    return F.array_join(F.transform(sents, lambda s: F.array_join(rouge_tokens(s), " ")), "\n")


def _incidence(lines: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sentence, word) of every token as numbers, and how many sentences and words there are."""
    words: dict[str, int] = {}
    which, size = [], []
    for line in lines.split("\n"):
        tokens = line.split(" ") if line else []
        which += [words.setdefault(t, len(words)) for t in tokens]
        size.append(len(tokens))
    return np.repeat(np.arange(len(size)), size), np.array(which, np.int64), len(size), len(words)


def frequency_scores(lines: str) -> np.ndarray:
    """Mean in-document frequency of each sentence's words; -1 for a sentence without words."""
    sent, word, n, words = _incidence(lines)
    count = np.bincount(word, minlength=words)
    total, size = np.bincount(sent, count[word], n), np.bincount(sent, minlength=n)
    return np.where(size > 0, total / np.maximum(size * len(word), 1), -1.0)


def textrank_scores(lines: str, iterations: int = 20, damping: float = 0.85) -> np.ndarray:
    """PageRank of the sentences over shared-word counts, to 9 digits; -1 for a sentence without words.

    W = A A^T - diag (A: sentence x distinct-word incidence); a round is two sums over the incidence, so no pair of
    sentences is formed.  A sentence that shares no word keeps 1 - damping."""
    sent, word, n, words = _incidence(lines)
    if len(sent):
        pair = np.unique(sent * words + word)
        sent, word = pair // words, pair % words
    size = np.bincount(sent, minlength=n)
    degree = np.bincount(sent, (np.bincount(word, minlength=words) - 1)[word], n)
    s = np.ones(n)
    for _ in range(iterations):
        q = np.where(degree > 0, s / np.where(degree > 0, degree, 1), 0.0)
        mass = np.bincount(word, q[sent], words)
        s = (1 - damping) + damping * (np.bincount(sent, mass[word], n) - q * size)
    return np.where(size > 0, np.round(s, 9), -1.0)


def _best_sentences(df: DataFrame, scores: Callable[[str], np.ndarray], n: int, text: str, out: str) -> DataFrame:
    """``df`` with the n best sentences of each row in document order (ties: the earlier one); all inside the row."""
    @F.pandas_udf(T.StringType())
    def chosen(lines: pd.Series, whole: pd.Series) -> pd.Series:
        def pick(t: str, sents: list[str]) -> str:
            s = scores(t)
            best = np.lexsort((np.arange(len(s)), -s))[:n]
            return " ".join(sents[i] for i in np.sort(best[s[best] >= 0]))
        return pd.Series([pick(t, w.split("\n")) for t, w in zip(lines, whole)], dtype=object)

    x = df.withColumn("_sents", sentences(clean_text(F.col(text)), cleaned=True))  # cleaned text has no line breaks
    return x.withColumn(out, chosen(_token_lines(F.col("_sents")), F.array_join("_sents", "\n"))).drop("_sents")


def summarize_frequency(df: DataFrame, n: int = 3, text: str = "source", out: str = "summary") -> DataFrame:
    """I15 frequency: score(sentence) = avg over its tokens of count_doc(token)/|doc|."""
    return _best_sentences(df, frequency_scores, n, text, out)


def summarize_textrank(df: DataFrame, n: int = 3, text: str = "source", out: str = "summary",
                       iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """I15 TextRank over shared-word edges, without sentence pairs."""
    return _best_sentences(df, lambda t: textrank_scores(t, iterations, damping), n, text, out)


#: Models of this worker process by the tag of their loader.
_LOADED: dict[str, Callable] = {}


class LoadOnce:
    """A model that every worker process loads when it first needs it, and once."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[str]]]):
        self.load, self.tag = load, uuid.uuid4().hex

    def __call__(self, texts: list[str]) -> list[str]:
        if self.tag not in _LOADED:
            _LOADED[self.tag] = self.load()
        return _LOADED[self.tag](texts)


def summarize_loaded(df: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], text: str = "source", out: str = "summary",
                     system: str = "model", max_tokens: int = 512, batch_size: int = 64) -> DataFrame:
    """``summarize`` with a model that ``load`` returns, loaded once per worker process, over the first
    ``max_tokens`` whitespace tokens of each text (cut before anything leaves the JVM)."""
    tokens = whitespace_tokens(text)
    cut = F.when(F.size(tokens) > max_tokens, join_tokens(F.slice(tokens, 1, max_tokens))).otherwise(F.coalesce(F.col(text), F.lit("")))
    return summarize(df.withColumn("_cut", cut), LoadOnce(load), "_cut", out, system, None, batch_size).drop("_cut")


def summarize(df: DataFrame, model: Callable[[list[str]], list[str]], text: str = "source",
              out: str = "summary", system: str = "model", max_chars: int | None = None,
              batch_size: int = 64) -> DataFrame:
    """I14 + I20: run a user model over whole tables in Arrow batches.

    ``model`` maps a list of texts to a list of summaries and is called once
    per batch; if a batch fails, rows are retried one by one and a failing
    row gets ``status = 'Error'`` instead of stopping the job.  ``latency_ms``
    is the batch's model time per row (D13).
    """
    cols = df.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf[text].fillna("").astype(str)
            if max_chars:
                texts = texts.str.slice(0, max_chars)
            outs, status, lat = [], [], []
            for start in range(0, len(texts), batch_size):
                chunk = list(texts.iloc[start:start + batch_size])
                t0 = time.perf_counter()
                try:
                    res = list(model(chunk))
                    if len(res) != len(chunk):
                        raise ValueError("model returned a different number of rows")
                    outs.extend(res)
                    status.extend(["ok"] * len(chunk))
                except Exception:  # noqa: BLE001 — isolate per row
                    for t in chunk:
                        try:
                            outs.append(str(model([t])[0]))
                            status.append("ok")
                        except Exception:  # noqa: BLE001
                            outs.append("")
                            status.append("Error")
                lat.extend([(time.perf_counter() - t0) * 1000.0 / max(len(chunk), 1)] * len(chunk))
            pdf = pdf.copy()
            pdf[out] = outs
            pdf["status"] = status
            pdf["system"] = system
            pdf["latency_ms"] = lat
            yield pdf

    schema = T.StructType(list(df.select(*cols).schema.fields) + [
        T.StructField(out, T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("system", T.StringType()), T.StructField("latency_ms", T.DoubleType())])
    return df.select(*cols).mapInPandas(run, schema)

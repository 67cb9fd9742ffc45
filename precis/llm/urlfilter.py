"""URL filters by hashed host-suffix and path-prefix expressions (operator 10).

Every URL is expanded into expressions ``host suffix + path prefix``; the
expressions are equi-joined with the rules on a short prefix of their SHA-256,
the full digest is confirmed, and the longest fitting rule decides.

Expansion is exact: all label suffixes of the host, and of the path the
prefixes whose lengths occur in the rule table (a rule fits when the path
starts with its path, at any character).  URLs are reduced to distinct (host,
path) pairs first, so a host that holds a third of all rows is expanded once
per path.

Everything is DataFrame expressions.  Defined results: a null URL or one
without ``://`` has empty host and path; no rule fits an empty host; a URL
without a rule gets ``default`` (allow); a rule listed twice counts once; of
equally long rules that fit, a block wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["host_of", "path_of", "rule_table", "expressions", "judge"]

#: Digits (hex) of the short digest that the join uses.
SHORT = 8
#: Rules up to this many are broadcast (about 200 bytes each); a larger table is shuffled.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(url, "(?s)://(.*)$", 1), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table of rules with their digests."""
    r = spark.createDataFrame([tuple(x) for x in rules], "verdict string, host string, path string")
    return _digested(r.select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("path_length")))


def _digested(df: DataFrame) -> DataFrame:
    full = F.sha2(F.col("rule"), 256)
    return df.withColumn("digest", full).withColumn("short", F.substring(full, 1, SHORT))


def expressions(pairs: DataFrame, path_lengths: Sequence[int]) -> DataFrame:
    """One row per (host, path, expression): host suffixes by label times path prefixes of the given lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    lengths = F.filter(F.array(*[F.lit(int(x)) for x in path_lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    both = pairs.where(F.col("host") != "").select("host", "path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
    return both.select("host", "path", F.explode("_prefixes").alias("_prefix"), "_suffix").select(
        "host", "path", F.concat("_suffix", "_prefix").alias("rule"), F.length("_prefix").alias("path_length"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (null if none) and verdict; replaces columns of these names."""
    clash = [c for c in urls.columns if c in ("host", "path", "rule", "verdict") and c != url]
    rows = urls.drop(*clash).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())  # one per length of a rule's path
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    table = rules.select("short", "digest", "verdict", F.col("path_length").alias("_pl")).distinct()
    e = _digested(expressions(rows.select("host", "path").distinct(), lengths or [0]))
    hit = e.join(F.broadcast(table) if small else table, "short").where(
        (e["digest"] == table["digest"]) & (e["path_length"] == table["_pl"]))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("n"), (F.col("verdict") == "block").alias("blocks"), F.col("rule").alias("rule"),
        F.col("verdict").alias("verdict"))).alias("_best"))
    return rows.join(best, ["host", "path"], "left").select(
        *[c for c in rows.columns if c not in ("host", "path")], "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

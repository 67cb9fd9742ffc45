"""Evaluation over whole tables.

Results are kept long — (id, system, summary, status, metrics...) — and made
wide only at the end (pivot with explicit values, so no extra job to find
them).  The bootstrap is a Poisson bootstrap (each row gets a deterministic
Poisson(1) weight per replicate from a hash of (id, replicate)), which is
the form of resampling that distributes: replicate means are partial
aggregates, and only ``systems x replicates`` rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.operators.rouge import rouge_columns

__all__ = ["run_systems", "score_systems", "mean_scores", "comparison_report", "unpivot_report",
           "bootstrap_scores", "replicate_sums", "status_counts", "poisson1", "POISSON1_CDF", "zip_pairs",
           "score_or_zero", "join_systems", "latency_stats", "run_metrics"]

# Poisson(1) cumulative probabilities P(K <= k), k = 0..12 (computed, not looked up).
POISSON1_CDF = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(13)]


_M32 = 1 << 32
#: Groups whose replicate sums a task holds, and rows whose weights it draws at once.
GROUPS, ROWS = 1024, 512


def replicate_uniform(k: Column, b: Column) -> Column:
    """u in [0, 1) from a 32-bit row key and a replicate number: add, then two
    xor-shift-multiply rounds modulo 2^32 (every product stays below 2^63)."""
    x = (k + b.cast("bigint") * F.lit(2654435761)) % F.lit(_M32)
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475)) % F.lit(_M32)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return x.cast("double") / F.lit(float(_M32))


def poisson1(u: Column) -> Column:
    """Inverse CDF of Poisson(1) for u in [0, 1) (tail beyond 12 -> 13)."""
    expr = None
    for k, c in enumerate(POISSON1_CDF):
        cond = u < F.lit(c)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr.otherwise(F.lit(len(POISSON1_CDF)))


def run_systems(df: DataFrame, systems: Mapping[str, Callable[[DataFrame], DataFrame]],
                summary: str = "summary") -> DataFrame:
    """I19 + I20: each system maps the input rows to rows with a ``summary``
    column; results are unioned long with ``system`` and ``status``
    ('Missing' for empty output, or the system's own status).  A system that
    is absent (``None``) or returns nothing gives its rows as 'Missing', one
    that fails to build gives them as 'Error' with the text in ``error``;
    the others go on."""
    outs = []
    for name, fn in systems.items():
        failed, why = None, None
        try:
            o = fn(df) if fn is not None else None
            failed = "Missing" if o is None else None
        except Exception as e:  # noqa: BLE001 — one system must not end the run; its error is in the output
            failed, why = "Error", f"{type(e).__name__}: {e}"[:500]
        if failed:
            o = df.withColumn(summary, F.lit("")).withColumn("status", F.lit(failed))
        st = F.col("status") if "status" in o.columns else F.lit("ok")
        empty = F.coalesce(F.length(summary), F.lit(0)) == 0
        lat = F.col("latency_ms") if "latency_ms" in o.columns else F.lit(None).cast("double")
        o = o.withColumn("status", F.when((st == F.lit("ok")) & empty, F.lit("Missing")).otherwise(st)) \
             .withColumn("system", F.lit(name)).withColumn("latency_ms", lat).withColumn("error", F.lit(why).cast("string"))
        outs.append(o.select(*df.columns, "system", summary, "status", "latency_ms", "error"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def score_systems(long: DataFrame, ref: str = "target", summary: str = "summary",
                  kinds: Sequence[str] = ("rouge1", "rouge2", "rougeL"), stem: bool = False) -> DataFrame:
    """Per-row ROUGE of each system output (struct columns rouge1, ...)."""
    return rouge_columns(long, summary, ref, kinds, stem)


def score_or_zero(c) -> Column:
    """A missing score counts as 0."""
    return F.coalesce(c, F.lit(0.0))


def mean_scores(scored: DataFrame, kinds: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
                by: Sequence[str] = ("system",), digits: int = 6) -> DataFrame:
    """Mean F per system (partial + final aggregate)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.round(F.avg(score_or_zero(F.col(f"{k}.fmeasure"))), digits).alias(f"{k}_f") for k in kinds]
    return scored.groupBy(*by).agg(*aggs)


def comparison_report(scored: DataFrame, systems: Sequence[str],
                      kinds: Sequence[str] = ("rouge1", "rouge2", "rougeL"), digits: int = 6) -> DataFrame:
    """Metric x system table of mean F (one row per metric)."""
    stacked = scored.select("system", F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), score_or_zero(F.col(f"{k}.fmeasure")).alias("v")) for k in kinds
    ])).alias("m")).select("system", "m.metric", "m.v")
    wide = stacked.groupBy("metric").pivot("system", list(systems)).agg(F.avg("v"))
    return wide.select("metric", *[F.round(F.col(s), digits).alias(s) for s in systems])


def unpivot_report(report: DataFrame, systems: Sequence[str]) -> DataFrame:
    """D12 inverse: back to (metric, system, value)."""
    return report.unpivot(["metric"], list(systems), "system", "value")


def join_systems(scored: DataFrame, systems: Sequence[str], col: str = "summary", key: str = "id") -> DataFrame:
    """C4: one row per example with each system's output side by side."""
    return scored.groupBy(key).pivot("system", list(systems)).agg(F.first(col))


def zip_pairs(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Positional zip re-expressed as a 1:1 equi-join on the key; a key
    that one side holds twice is an error, not a product."""
    once = lambda d: d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    j = once(left).withColumnRenamed("_n", "_l").join(once(right).withColumnRenamed("_n", "_r"), key)
    ok = F.when((F.col("_l") == 1) & (F.col("_r") == 1), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("zip_pairs: key occurs more than once: "), F.col(key).cast("string"))).cast("boolean"))
    return j.where(ok).drop("_l", "_r")


def _weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weight of every key (row) in replicates 1..n (columns); ``replicate_uniform`` and ``poisson1`` on arrays."""
    b = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(2654435761)
    x = (keys.astype(np.uint64)[:, None] + b) % np.uint64(_M32)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) % np.uint64(_M32)
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(POISSON1_CDF), x / float(_M32), side="right")


def replicate_sums(rows: DataFrame, by: Sequence[str], replicates: int) -> DataFrame:
    """(by..., b, w, wx): sums of weight and weight x value per replicate, from rows (by..., _k, _x).

    One Arrow pass: a task keeps two arrays of ``replicates`` sums per group and adds its rows to them; the arrays of
    all tasks are then summed.  No row is repeated; a null value has a weight and adds nothing."""
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out():
            groups = list(sums)
            cols = [pa.array([g[i] for g in groups], type=types[i]) for i in range(len(by))]
            both = [pa.array([sums[g][i].tolist() for g in groups], type=pa.list_(pa.float64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*cols, *both], names=[*by, "w", "wx"])

        types = None
        for b in batches:
            types = [b.schema.field(c).type for c in by]
            k, x = b.column("_k").to_numpy(), b.column("_x").to_numpy(zero_copy_only=False).astype(float)
            names = list(zip(*[b.column(c).to_pylist() for c in by], strict=True)) if by else [()] * b.num_rows
            at: dict[tuple, list[int]] = {}
            for i in np.flatnonzero(~np.isnan(x)).tolist():
                at.setdefault(names[i], []).append(i)
            for g, some in at.items():
                if g not in sums:
                    if len(sums) >= GROUPS:
                        yield out()
                        sums.clear()
                    sums[g] = np.zeros((2, replicates))
                for j in range(0, len(some), ROWS):
                    part = np.array(some[j:j + ROWS])
                    w = _weights(k[part], replicates).astype(float)
                    sums[g][0] += w.sum(axis=0)
                    sums[g][1] += x[part] @ w
        if sums:
            yield out()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "w array<double>", "wx array<double>"])
    parts = rows.select(*by, "_k", "_x").mapInArrow(run, schema)
    ex = parts.select(*by, F.posexplode(F.arrays_zip("w", "wx")).alias("b", "s"))  # replicates x groups x tasks
    return ex.groupBy(*by, "b").agg(F.sum("s.w").alias("w"), F.sum("s.wx").alias("wx"))


def bootstrap_scores(scored: DataFrame, value: Column, replicates: int = 1000, seed: int = 42,
                     by: Sequence[str] = ("system",), key: str = "id",
                     quantiles: Sequence[float] = (0.025, 0.5, 0.975), digits: int = 6) -> DataFrame:
    """Poisson-bootstrap interval of a mean: (low, mid, high) per group.

    Weight of row r in replicate b: Poisson(1) inverse CDF of a uniform from
    the row's 32-bit key (md5('<id>:<seed>'), computed once per row) mixed with
    b — identical for every system, so the comparison is paired.
    """
    k = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10)
    rows = scored.select(*by, k.cast("bigint").alias("_k"), value.cast("double").alias("_x"))
    reps = replicate_sums(rows, by, replicates).select(*by, F.try_divide("wx", "w").alias("m"))
    q = F.percentile(F.col("m"), F.array(*[F.lit(x) for x in quantiles]))
    out = reps.where(F.col("m").isNotNull()).groupBy(*by).agg(q.alias("_q"))
    names = ["low", "mid", "high"] if len(quantiles) == 3 else [f"q{i}" for i in range(len(quantiles))]
    return out.select(*by, *[F.round(F.col("_q")[i], digits).alias(n) for i, n in enumerate(names)])


def latency_stats(long: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    """Inference time per row: mean and approximate median / p95."""
    return long.where(F.col("latency_ms").isNotNull()).groupBy(*by).agg(
        F.avg("latency_ms").alias("avg_ms"),
        F.percentile_approx("latency_ms", [0.5, 0.95], 1000).alias("p50_p95_ms"))


def run_metrics(scored: DataFrame, metrics: Sequence[Callable[[DataFrame], DataFrame]],
                key: Sequence[str] = ("system",)) -> DataFrame:
    """K4: metric callbacks, each ``DataFrame -> DataFrame`` keyed by ``key``,
    joined side by side."""
    out = None
    for m in metrics:
        r = m(scored)
        out = r if out is None else out.join(r, list(key), "full")
    return out


def status_counts(long: DataFrame) -> DataFrame:
    """Rows per (system, status)."""
    return long.groupBy("system", "status").agg(F.count(F.lit(1)).alias("rows"))

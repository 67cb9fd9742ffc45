"""File sources / sinks and artifact hand-offs.

Parquet is the default hand-off format; CSV exists because the reference
exchanges split and result files as CSV.  Iterative jobs persist each round as
``<base>/round=<n>`` so a restarted job resumes from the last finished round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.session import scratch_path

__all__ = [
    "PAIR_SCHEMA", "sample_pairs", "read_or_sample", "read_pairs_csv", "write_pairs_csv",
    "write_results_csv", "write_corpus_lines", "read_text_documents", "save_table",
    "load_table", "import_bpe_files", "export_bpe_files", "path_exists", "drop_path", "handed_over", "ensure_artifact", "resume_from",
    "save_round", "load_round", "SAMPLE_PAIRS",
]

PAIR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("dialogue", T.StringType()),
    T.StructField("summary", T.StringType()),
])

# The built-in fallback sample (five pairs, repeated 20 times).
SAMPLE_PAIRS = [
    ("Hi, how are you? I'm good. How about you? good too.", "Two people exchange greetings."),
    ("Can we meet at 5? Sure, see you there. Bye.", "They agree to meet at 5 pm."),
    ("Did you see the match? Yes, it was amazing! What a goal by Messi.", "They discuss the football match."),
    ("Mom called. What did she say? She wants us to visit. Okay.", "Mom wants them to visit."),
    ("Let's go for lunch. Pizza? No, burgers. Fine, burgers.", "They decide to have burgers for lunch."),
]


def sample_pairs(spark: SparkSession, repeat: int = 20) -> DataFrame:
    """A4: the literal sample, ``id`` = '0'..'99' (five pairs cycled)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in SAMPLE_PAIRS])
    n = len(SAMPLE_PAIRS)
    r = spark.range(n * repeat).withColumn("p", F.element_at(pairs, (F.col("id") % n + 1).cast("int")))
    return r.select(F.col("id").cast("string").alias("id"),
                    F.col("p.d").alias("dialogue"), F.col("p.s").alias("summary"))


def read_or_sample(spark: SparkSession, candidates: Sequence[str],
                   reader: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """A3: first candidate that loads, else the built-in sample."""
    reader = reader or (lambda s, p: s.read.parquet(p))
    for path in candidates:
        try:
            df = reader(spark, path)
            df.schema  # force analysis (missing path -> AnalysisException)
            return df
        except AnalysisException:
            continue
    return sample_pairs(spark)


def read_pairs_csv(spark: SparkSession, path: str, schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """A5: header CSV with an explicit schema; missing values -> ''."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(path))
    return df.na.fill("")


def write_pairs_csv(df: DataFrame, path: str, partition_by: str | None = "split") -> None:
    """Header CSV, one folder per split (partition pruning on read)."""
    w = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    """Evaluation results as header CSV."""
    write_pairs_csv(df, path, partition_by=None)


def write_corpus_lines(df: DataFrame, path: str, cols=("source", "target")) -> None:
    """Each text column as its own line (tokenizer-training corpus)."""
    df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("value")).write.mode("overwrite").text(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per uploaded text file (UTF-8), keyed by its path."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def save_table(df: DataFrame, path: str) -> None:
    """Persist a table (vocabulary, merges, round) as Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_bpe_files(spark: SparkSession, vocab_json: str, merges_txt: str) -> tuple[DataFrame, DataFrame]:
    """A10: tokenizer files -> ``bpe_vocab(token, id)``, ``bpe_merges(rank, left, right)``.

    Both files are bounded by the vocabulary size, so each is read as one
    whole-text row and exploded on the executors.
    """
    vj = spark.read.text(vocab_json, wholetext=True)
    vocab = vj.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    mt = spark.read.text(merges_txt, wholetext=True)
    # only the first line may be a version line; ranks count the lines behind it
    head = F.when(F.col("value").startswith("#version"), 1).otherwise(0)
    lines = mt.select(head.alias("head"), F.posexplode(F.split("value", "\n")).alias("pos", "line")) \
              .where((F.col("pos") >= F.col("head")) & (F.col("line") != ""))
    merges = lines.select((F.col("pos") - F.col("head")).alias("rank"), F.split("line", " ").alias("p")) \
                  .select("rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))
    return vocab, merges


def export_bpe_files(vocab: DataFrame, merges: DataFrame, vocab_json: str, merges_txt: str) -> None:
    """A10: the inverse of ``import_bpe_files``: one JSON object of token ids, and one line per merge behind a version
    line.  A tokenizer file is one ordered text bounded by the vocabulary size, so each is one row of one partition."""
    pairs = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))),
                                           lambda s: F.struct(s["token"].alias("k"), s["id"].alias("v"))))
    vocab.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(vocab_json)
    line = F.concat(F.col("left"), F.lit(" "), F.col("right")).alias("line")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line))), lambda s: s["line"])
    merges.agg(F.array_join(F.concat(F.array(F.lit("#version: 0.2")), lines), "\n").alias("value")).coalesce(1) \
          .write.mode("overwrite").text(merges_txt)


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def file_listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the files under ``path``, in order of path."""
    fs, p = _fs_path(spark, path)
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    return sorted(out)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a hand-off table that nothing reads any more."""
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def handed_over(df: DataFrame, tag: str, spark: SparkSession) -> tuple[DataFrame, str]:
    """``df`` as a written table of the shared folder, read by ``spark`` (a stream's micro-batch has a session of its own), and its path."""
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ensure_artifact(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Load the artifact if it exists, else build it, write it, read it back."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        save_table(build(), path)
    return load_table(spark, path)


def save_round(df: DataFrame, base: str, n: int) -> DataFrame:
    """Persist round ``n``; the written table cuts the lineage."""
    path = f"{base.rstrip('/')}/round={n}"
    save_table(df, path)
    return df.sparkSession.read.parquet(path)


def load_round(spark: SparkSession, base: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/round={n}")


def resume_from(spark: SparkSession, base: str) -> int:
    """Last finished round under ``base`` (-1 when none)."""
    if not path_exists(spark, base):
        return -1
    fs, p = _fs_path(spark, base)
    best = -1
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("round=") and fs.exists(st.getPath().suffix("/_SUCCESS")):
            try:
                best = max(best, int(name.split("=", 1)[1]))
            except ValueError:
                pass
    return best

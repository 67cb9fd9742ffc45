"""Session helpers: a configured SparkSession and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "precis",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, ``master`` stays ``None`` so spark-submit decides; tests
    pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster (``spark.checkpoint.dir``)."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; only a local session without one
    (tests, laptops) gets a private scratch folder."""
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="precis-ckpt-", dir=os.environ.get("PRECIS_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Bytes of an Arrow batch that goes to a Python worker.  Spark's own bound is 64 MB (10,000 rows); strings take several times
#: as much as Python objects, in each worker, so a worker's memory would follow the rows in a partition up to there.
ARROW_BATCH = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BATCH`` bytes, unless the session has a smaller bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    has = spark.conf.get(name, None) or ""
    if not has.rstrip("b").isdigit() or int(has.rstrip("b")) > ARROW_BATCH:
        spark.conf.set(name, str(ARROW_BATCH))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written hand-off tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def ship_package(spark: SparkSession) -> None:
    """Make ``precis`` importable in executor Python workers (pandas UDFs,
    mapInPandas, state functions), like ``spark-submit --py-files``: the
    package is zipped once on the driver and added with ``addPyFile``."""
    sc = spark.sparkContext
    if getattr(sc, "_precis_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="precis-pkg-"), "precis.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._precis_shipped = True

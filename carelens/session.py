"""Session helpers: sane defaults for local runs and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on. AQE re-plans joins and coalesces
# partitions at runtime; skew-join splitting guards against one hot patient or a
# NULL encounter key holding a large share of the rows.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.ui.enabled": "false",
    # remove checkpoint files once the checkpointed frames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "carelens") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CARELENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names.

    A local session (one JVM, as in tests) without the setting gets a scratch folder of its own;
    on a cluster a missing setting is an error, as executors share no local folder.
    """
    sc = _context(spark)
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="carelens-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once to ``path`` and read from there; the shuffle files that made it are removed when it is written.

    Spark keeps a frame's shuffle files for its next use, until the driver collects the frame. This one is not used again.
    """
    spark = df.sparkSession
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def _context(spark: SparkSession):
    """The SparkContext, or None for sessions without one (e.g. Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:
        return None

"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "quire", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(SETTINGS)
    conf.update({
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: their Python workers may start in any folder."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "quire.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._quire_shipped = True


# Bytes of an Arrow batch on its way to Python, which is held whole there.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES in this session from here on, so that whole texts reach Python a few at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not (now.isdigit() and 0 < int(now) <= ARROW_BYTES):
        spark.conf.set(name, str(ARROW_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when they come in fewer partitions than that, from one small file say.

    Larger inputs bring more partitions than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# Rows of a few numbers and ids that may be sent to every executor (some tens of megabytes).
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """A checkpointed table of narrow rows, marked for broadcast when its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and fixes what it holds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Spark session defaults for running the warehouse.

On a cluster the session normally comes from the platform; :func:`configure`,
which every ``Warehouse`` calls, only adds what the plans rely on and never
overrides a value that is set.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings the plans are designed around.
DEFAULTS = {
    # Runtime re-planning: measured-size broadcast, partition coalescing,
    # splitting of skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A report may aggregate per contract right after a join on the contract, which reuses the
    # join's partitioning; without this, AQE would then leave a contract that holds a large
    # part of all rows in one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Size-driven coalescing: merge shuffle partitions up to the advisory size
    # instead of keeping them small for parallelism.  The size is that of compressed
    # shuffle files; a join's sorts, a window and the aggregation behind it hold 12 to 25
    # times as much, so 16 MB keep a task at a few hundred MB at any scale factor
    # (with spark.sql.shuffle.partitions set for the size of the tables).
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Never start the web UI from a job.
    "spark.ui.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in DEFAULTS.items():
        if not k.startswith("spark.ui") and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/") + "/"


def checkpoint_folder(spark: SparkSession) -> str:
    """The one folder for checkpoints and intermediate tables that driver and executors share.

    ``spark.checkpoint.dir`` of the session, or else the directory set on the
    context.  Only a single-machine session with neither (a test, a smoke run)
    gets a temporary folder; a cluster session without one is an error.
    ``DataFrame.checkpoint()`` writes below the same folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or current
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="subledger-ckpt-")
    if current is None or not _plain(current).startswith(_plain(folder)):
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "subledger", **extra) -> SparkSession:
    """A local session for tests and benchmarks, with a checkpoint folder of its own if none is given."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", "16g")
    if "spark.checkpoint.dir" not in extra:
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="subledger-ckpt-")
    for k, v in {**DEFAULTS, "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)

"""Session helpers shared by tests, the bench and the plans."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "equitally") -> SparkSession:
    """A local session configured the way the library expects a cluster to be.

    On a cluster the caller builds its own session; nothing here is required
    by the library code itself.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cores
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EQUITALLY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local runs,
    tests) a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # one machine, one JVM
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="equitally-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)  # a folder made here goes with this process
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a lineage cut that later passes read column-pruned, and that
    survives executor loss (unlike cached or locally checkpointed blocks)."""
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# Rows that are worth a task of their own where a pass over them is short, and
# rows that a task takes at most; between the two every core has one task.
ROWS_PER_TASK, MOST_PER_TASK = 20_000, 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for repeated passes over ``rows`` rows."""
    wide = max(spark.sparkContext.defaultParallelism, -(-rows // MOST_PER_TASK))
    return max(1, min(-(-rows // ROWS_PER_TASK), wide))


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt evenly over ``tasks_for`` them
    (by the hash of ``key``, if given), however few files or row groups they
    lie in.  Rows that one task takes stay as they are."""
    n = tasks_for(df.sparkSession, rows)
    return df.repartition(n, *key) if n > 1 else df


def model_tables(spark: SparkSession | None = None) -> str:
    """Where registered queries leave fitted models as tables, for another
    engine to score the same rows: under the shared folder of a cluster; on one
    machine at a fixed place that needs no session to be known."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir').rstrip('/')}/model-tables"
    return os.path.join(tempfile.gettempdir(), "equitally-models")


# Settings a cluster session should carry for these jobs (all public Spark
# configuration keys); pass them to SparkSession.builder.config(...).
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",                      # runtime re-planning
    "spark.sql.adaptive.coalescePartitions.enabled": "true",   # merge tiny post-shuffle partitions
    "spark.sql.adaptive.skewJoin.enabled": "true",             # split hot join partitions
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",               # fewer, larger scan tasks
    "spark.sql.shuffle.partitions": "4000",                    # upper bound; AQE coalesces down
    "spark.sql.autoBroadcastJoinThreshold": "64m",             # measured-size broadcast limit
    "spark.sql.parquet.filterPushdown": "true",
}

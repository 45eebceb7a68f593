"""Session construction and the shared scratch location.

Every intermediate that must outlive a task (round-trip files, stream
feeds, stream checkpoints, lineage cuts) goes under the folder the cluster
names in ``spark.checkpoint.dir``.  We only pick a folder ourselves when the
session has none (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # commit only the changes of each micro-batch, snapshot in the background
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app_name: str = "widestat", **extra: str) -> SparkSession:
    """Build (or reuse) a session with UTC time, ANSI and AQE switched on."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  When
    neither is set, a local run makes a fresh folder under the system temp
    directory and registers it, so later calls agree; on a cluster, whose
    executors could not see such a folder, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        root = root or sc.getCheckpointDir()
    except Exception:  # a Spark Connect session has no SparkContext
        pass
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="widestat-")
    if sc is not None:
        sc.setCheckpointDir(root)
    try:
        spark.conf.set("spark.checkpoint.dir", root)
    except Exception:
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of ours (nothing outside the scratch folder)."""
    if not path.startswith(f"{checkpoint_root(spark)}/scratch/"):
        raise ValueError(f"not a scratch path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep ``df`` cached while a block fans out over it, and drop it after.

    For reuse inside one job graph; to cut lineage (and survive losing the
    executors that hold the blocks) write a table under ``checkpoint_root``
    instead, as ``plans.etl.settle`` does.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()

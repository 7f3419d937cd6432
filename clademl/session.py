"""Spark session defaults and lineage helpers.

The library never picks a machine-local folder on a cluster: reliable
checkpoints go to ``spark.checkpoint.dir`` as configured by the cluster. Only a
``local[...]`` session without that setting (tests, the bench) gets a scratch
folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Size above which a side is never broadcast implicitly (bytes).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def get_spark(master: str | None = None, app: str = "clademl", shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """Create (or reuse) a session with the settings the library relies on."""
    master = master or os.environ.get("CLADEML_MASTER", "local[*]")
    if shuffle_partitions is None:
        shuffle_partitions = 8 if master.startswith("local") else 2000
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="clademl-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)  # otherwise the checkpoint job computes df twice
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back: later readers prune
    columns, and open committed files whichever executors are still there."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/clademl-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def persist(df: DataFrame) -> DataFrame:
    """Cache for repeated use (recomputed from lineage if an executor is lost)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def wide_table_conf(spark: SparkSession) -> None:
    """Settings for tables with many derived columns (runtime SQL confs of the session).

    Constraint propagation enumerates implied predicates over every alias of a
    wide projection and can take minutes in the optimizer; it buys nothing here.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")

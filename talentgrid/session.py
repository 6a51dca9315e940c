"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on. Shuffle partitions stay a session
# choice: on a cluster size them so a partition is ~128-256 MB of shuffle data.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "talentgrid", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults.

    ``master`` is only meant for tests / local runs; on a cluster the launcher
    decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/…) folder and is
    used as is; without it a cluster run is refused. Only in local mode (tests, local runs)
    a private scratch folder is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="talentgrid-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def spread(df, key: str | None = None):
    """Guard against under-split scans: a file with a single row group is read by one
    task, which would run every per-row text operator on one core. When the scan has
    fewer partitions than the cluster has cores, hash-partition it by its key into
    ``spark.sql.shuffle.partitions`` parts (later aggregations on the same key then need
    no further exchange). On a cluster reading many files this is a no-op."""
    spark = df.sparkSession
    n = df.rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    if n >= cores:
        return df
    from pyspark.sql import functions as F
    # enough parts to keep every core busy, not the (possibly large) shuffle default
    parts = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), cores * 4))
    out = df.repartition(parts, key) if key and key in df.columns else df.repartition(parts)
    # Catalyst would push later (possibly costly) predicates below the exchange, back
    # into the single scan task; an always-true but non-deterministic filter is a
    # barrier it does not cross, so that work runs on all partitions.
    return out.filter(F.spark_partition_id() >= 0)


def materialize(df):
    """Write an intermediate result to the shared checkpoint folder and read it back
    (eager, reliable ``checkpoint()``): used for a derived table that several branches of
    one plan consume, so the expensive work upstream runs once and a lost executor
    re-reads files instead of recomputing the whole lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

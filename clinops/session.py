"""Session helpers.

On a cluster the session comes from the platform (``spark-submit``) and we
only read its settings.  For tests and the local bench we build a
``local[N]`` session with settings sized for the box.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry.  They are safe at cluster scale:
# AQE re-plans joins from runtime sizes, coalesces small shuffle partitions
# and splits skewed ones.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture for error messages costs extra JVM round trips
    # on every Column call while plans are built; off for batch jobs.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # reliable checkpoints (dense keys, summaries, merges) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(cpus: int | str = 8, shuffle_partitions: int | None = None,
              app_name: str = "clinops", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests / bench (``local[cpus]``)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    conf = dict(_BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(parts)
    conf["spark.driver.memory"] = os.environ.get("CLINOPS_DRIVER_MEMORY", "16g")
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we use it
    as is.  Only a local-mode session without one (tests, the local bench)
    gets a scratch folder; on a cluster a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        # a machine-local folder is useless to executors on other hosts
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for this job")
    local = tempfile.mkdtemp(prefix="clinops-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def cluster_conf(shuffle_bytes: float, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Settings to apply at submit time for a job whose largest shuffle moves
    about ``shuffle_bytes`` bytes (e.g. 100 TB input → tens of TB shuffled).

    Initial shuffle partitions are sized so each holds ~256 MB (AQE then
    coalesces small ones and splits skewed ones); never fewer than two waves
    of tasks over all cores.  Scan splits stay at 256 MB so a task's input fits
    executor memory without spilling on the read side.
    """
    cores = executors * cores_per_executor
    parts = max(2 * cores, int(shuffle_bytes // target_partition_bytes) + 1)
    return {
        **_BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.parquet.aggregatePushdown": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
    }

"""Session construction and the shared scratch location.

Scratch data (iteration checkpoints, streaming sources and sinks) lives under
the cluster-wide ``spark.checkpoint.dir``.  A private directory is only created
when that setting is absent *and* Spark runs in local mode (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes
# (small dimension outputs become broadcast joins only after their real size
# is known), coalesces small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Checkpoints of DataFrames that are no longer referenced (earlier
    # iteration rounds, finished queries) are removed by Spark's cleaner, so
    # iterative jobs do not keep every round on the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "tillwise",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, creating a local one only
    when none is configured and the session runs in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so lineage cuts survive executor loss")
        configured = tempfile.mkdtemp(prefix="tillwise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory below the shared checkpoint root."""
    root = checkpoint_root(spark)
    return os.path.join(root, "tillwise", f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this library's own, on whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20,
               shuffle_ratio: float = 0.5) -> dict[str, str]:
    """Shuffle/scan sizing for a cluster run.

    Scan splits of ``partition_bytes``; the shuffle is sized so each
    partition holds about that much of the expected shuffle volume
    (``shuffle_ratio`` of the input after projection), rounded up to whole
    waves of ``total_cores``.  AQE then coalesces small partitions and splits
    skewed ones at runtime.  E.g. 100 TB on 8,000 cores -> 192,000 shuffle
    partitions of ~256 MB.
    """
    target = max(1, int(input_bytes * shuffle_ratio // partition_bytes))
    waves = -(-target // total_cores)
    partitions = max(total_cores, waves * total_cores)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }

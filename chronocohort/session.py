"""Session settings the jobs rely on, and the shared folder for durable intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed shuffle partitions at run time.  Joins here are followed by
# aggregations on the join key, so the split must be allowed to add a shuffle (force...), or
# Spark would keep the hot key in one task.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Jobs over the clinical tables shuffle many times their input.  Many small partitions, merged where they hold little, keep what one
# task orders at tens of MB whatever the size of the tables; the cluster's number of partitions would let it grow with them.
PARTITIONS = 480
_PARTITION_BYTES = "16m"
# Stages are packed tightly, so a scan of the usual 128 MB holds millions of rows: what its task sorts spills, and few tasks do all the work of a step without a shuffle.
_SCAN_BYTES = 16 << 20
# Admissions of the cohort are a part of all; joins filter the other side by a Bloom filter of them (at most 8 MB) before it is shuffled.
_RUNTIME_FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64m",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 26),
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "24000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "24000000",
}


def tune_tables(spark: SparkSession) -> SparkSession:
    """``tune`` with small shuffle partitions and scans, and with runtime filters."""
    tune(spark)
    most = max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(most))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", _PARTITION_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(_SCAN_BYTES))
    for key, value in _RUNTIME_FILTERS.items():
        spark.conf.set(key, value)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; everything else stays as the cluster set it."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a new one in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="chronocohort-")
    sc.setCheckpointDir(made)
    return made


def output_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write a stage output to the shared folder and go on from there.

    The lineage ends here, so a lost executor costs no recomputation; as a parquet table it can also be
    pruned by column, and later joins are planned with its true size.  Stages are packed tightly, as they are most of what jobs write.
    """
    path = output_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)

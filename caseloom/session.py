"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every caseloom job expects.  AQE re-plans joins and coalesces
# partitions from runtime sizes; skew-join splits hot join keys.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "caseloom", cores: int | str = "*", shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (the UI stays off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # a checkpoint folder named by the deployment wins; ours only fills a gap
    if checkpoint_dir and not spark.conf.get("spark.checkpoint.dir", None) \
            and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def sized_conf(largest_shuffle_bytes: int, executor_cores_total: int,
               target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings for a cluster run, from the largest expected shuffle.

    Shuffle partitions ~ shuffle bytes / target (at least two waves of the
    cluster's cores, so a lost executor's tasks rerun in parallel); AQE
    merges small partitions back to the target size and splits skewed ones.
    The same count is the partition count of the range numbering.
    """
    parts = max(-(-largest_shuffle_bytes // target_partition_bytes), 2 * executor_cores_total)
    size = f"{target_partition_bytes // (1024 * 1024)}m"
    return dict(RECOMMENDED_CONF, **{
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * target_partition_bytes // (1024 * 1024)}m",
    })

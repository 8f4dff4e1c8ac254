"""Lineage cuts through reliable checkpoints in the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    on a local master (tests) a folder below the SQL warehouse is used.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        wh = spark.conf.get("spark.sql.warehouse.dir")
        conf_dir = wh.rstrip("/") + "/_caseloom_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: the result survives executor loss and
    every later read sees the same partitions and row order."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")

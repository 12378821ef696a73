"""Folders that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Have a checkpoint folder: the one the session names, or one of this machine's if Spark runs on it alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or "/tmp/checkpoints")
    folder = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)

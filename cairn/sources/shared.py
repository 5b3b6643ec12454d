"""The folder that all executors share, for what cuts a plan short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's own, else a folder of the warehouse, which executors share too."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``; the copy lives in the shared folder.

    It goes with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, else it stays until the folder is emptied.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

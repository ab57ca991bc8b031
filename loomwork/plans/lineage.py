"""Cutting the lineage of iterative plans in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or one in the warehouse where it is not set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in spark.checkpoint.dir; a folder in the warehouse where none is set.

    The warehouse is by default a folder of the driver's own disk: on a cluster set one of the two to a shared folder.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Cut points for plans whose input is read by several branches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the session: `spark.checkpoint.dir`, or a temporary one in a local session only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it from there.

    A running value reads its input twice, so nested ones would otherwise
    double the plan each time. The written copy also survives lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: merge small partitions, split hot join partitions, switch to broadcast by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder, shared_folder: str | None = None, cores: int | None = None) -> SparkSession.Builder:
    """Apply the settings; `shared_folder` is for checkpoints, `cores` sets shuffle partitions to three per core.

    Start with many shuffle partitions: adaptive execution merges them but cannot split an aggregate.
    """
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    if shared_folder:
        builder = builder.config("spark.checkpoint.dir", shared_folder)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(3 * cores))
    return builder

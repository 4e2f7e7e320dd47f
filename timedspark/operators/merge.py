"""Stored tables in hash buckets: a merge rewrites the buckets that its rows fall into and leaves the others alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from timedspark.operators.store import last_rows

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folder_exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored table, with its bucket as a partition column; a folder that is not there yet is an empty table."""
    if not _folder_exists(spark, path):
        return spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(None).cast("int"))
    return spark.read.schema(StructType([*schema.fields]).add(BUCKET, IntegerType())).parquet(path)


def merge_stored(path: str, changes: DataFrame, keys: list[str], order: str | None, buckets: int, batch: int | str) -> list[int]:
    """Upsert `changes` into the table at `path`; returns the buckets that were rewritten.

    The latest row per key by `order` stays, changes win a tie; without `order` changes always win, and a key then comes once in them.
    Only touched buckets are read (they are partitions) and only their folders are replaced. The new rows are
    first written beside the table under the name of the batch. A batch that ran into a failure is taken up from that copy, so
    it is safe to run again even if some folders were already replaced. The driver learns the numbers of the touched
    buckets, which `buckets` bounds. Rows are dealt by bucket, so each bucket is one task and one file; choose `buckets` for the size of the table.
    """
    spark = changes.sparkSession
    pending = f"{path}-pending/batch={batch}"
    if not _folder_exists(spark, pending + "/_SUCCESS"):
        named = changes.withColumn(BUCKET, bucket_of(keys, buckets))
        touched = [r[0] for r in named.select(BUCKET).distinct().collect()]
        held = read_stored(spark, path, changes.schema).filter(F.col(BUCKET).isin(touched))
        both = held.withColumn("__side", F.lit(0)).unionByName(named.withColumn("__side", F.lit(1)))
        by = [order, "__side"] if order else ["__side"]
        merged = last_rows(both, [BUCKET, *keys], *by).drop("__side")
        merged.repartition(max(len(touched), 1), BUCKET).write.mode("overwrite").parquet(pending)
    rows = spark.read.schema(StructType([*changes.schema.fields]).add(BUCKET, IntegerType())).parquet(pending)
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    if touched:
        (rows.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))
    return touched

"""Run a stream to the end of its input and read what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timedspark.operators.merge import BUCKET, merge_stored, read_stored
from timedspark.operators.stage import shared_folder, stage


#: Typed state and timers need a state store with column families.
KEYED_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Streams on the machine's clock would go on with empty batches for ever.
NO_EMPTY_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the streams started inside; a stream keeps what it was started with."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


class Feed:
    """A table handed to a stream in `parts` ranges of the column `by`, one range per round.

    Every round restarts the query from its checkpoint, as a scheduled job would.
    """

    def __init__(self, df: DataFrame, name: str, by: str, parts: int = 3):
        self.rows = stage(df)
        self.by, self.schema = by, df.schema
        cuts = self.rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
        self.edges = [None, *cuts, None]
        self.parts = len(self.edges) - 1
        self.path = new_folder(df.sparkSession, name)
        self.pushed = 0
        self.push()

    def push(self) -> None:
        low, high = self.edges[self.pushed], self.edges[self.pushed + 1]
        part = self.rows if low is None else self.rows.filter(F.col(self.by) > low)
        # Rows without a place come with the first range.
        unplaced = F.col(self.by).isNull() if low is None else F.lit(False)
        part = part if high is None else part.filter((F.col(self.by) <= high) | unplaced)
        part.write.mode("append").parquet(self.path)
        self.pushed += 1

    def stream(self) -> DataFrame:
        return stream_table(self.rows.sparkSession, self.path, self.schema)

    def run(self, writer) -> None:
        """Start the writer once per round until all ranges are through."""
        while True:
            writer.trigger(availableNow=True).start().awaitTermination()
            if self.pushed == self.parts:
                return
            self.push()


def run_upserts(feed: Feed, stream: DataFrame, keys: list[str], name: str, mode: str = "update", buckets: int = 16) -> DataFrame:
    """Changed rows of every batch are merged into a stored table, of which only the touched buckets are rewritten.

    A batch that runs again merges the same rows again, so replays change nothing. The merge reads its rows more than
    once, so they are written first: a batch is a running aggregate, which would else be worked out each time.
    """
    spark = stream.sparkSession
    target, schema = new_folder(spark, name), StructType(stream.schema.fields)

    def write(batch: DataFrame, number: int) -> None:
        merge_stored(target, stage(batch), keys, None, buckets, number)

    feed.run(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", target + "-state"))
    return read_stored(spark, target, schema).drop(BUCKET)


def run_batches(feed: Feed, stream: DataFrame, summary: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The summary of all rows, from a summary per batch; `summary` must give the same when applied to its own results.

    The stream keeps no state: a batch that runs again overwrites its own folder.
    """
    spark = stream.sparkSession
    target = new_folder(spark, name)
    schema = summary(spark.createDataFrame([], stream.schema)).schema

    def write(batch: DataFrame, number: int) -> None:
        summary(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    feed.run(stream.writeStream.foreachBatch(write).option("checkpointLocation", target + "-state"))
    return summary(spark.read.schema(schema).option("basePath", target).parquet(target + "/batch=*").drop("batch"))


def run_appends(feed: Feed, stream: DataFrame, name: str) -> DataFrame:
    """Append-mode rows to Parquet files."""
    spark = stream.sparkSession
    target = new_folder(spark, name)
    feed.run(stream.writeStream.outputMode("append").format("parquet").option("path", target)
             .option("checkpointLocation", target + "-state"))
    return spark.read.schema(stream.schema).parquet(target)


def run_carried(feed: Feed, stream: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], opened: str, name: str) -> DataFrame:
    """Rows that are final after each batch, where what is still open is carried to the next batch as a table.

    `step(batch, carried)` gives (final rows, rows to carry); `opened` is the schema of the carried rows. Both are
    written under the number of the batch and the carried ones are read from the one before, so a batch that runs again gives the same.
    """
    spark, target = stream.sparkSession, new_folder(stream.sparkSession, name)
    kind: list[StructType] = []

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        carried = session.read.schema(opened).parquet(f"{target}-open/batch={number - 1}") if number else session.createDataFrame([], opened)
        final, rest = step(batch, carried)
        kind[:] = [final.schema]
        final.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rest.write.mode("overwrite").parquet(f"{target}-open/batch={number}")

    feed.run(stream.writeStream.foreachBatch(write).option("checkpointLocation", target + "-state"))
    return spark.read.schema(kind[0]).option("basePath", target).parquet(target + "/batch=*").drop("batch")


def run_known(feed: Feed, stream: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], known: str, keep_ms: int, name: str) -> DataFrame:
    """Rows of each batch judged by what earlier batches found: `step(batch, found)` gives the rows to write.

    `found` are the written rows for which `known` holds, for `keep_ms` of the machine's time after their batch came
    (`came_ms`, which the stream's log fixes, is added to the batch and to `found`). There is no other state, and a
    batch that runs again reads only the batches before it and overwrites its own folder. A batch reads all that is still known.
    """
    spark, target = stream.sparkSession, new_folder(stream.sparkSession, name)
    timed = stream.withColumn("came_ms", F.unix_millis(F.current_timestamp()))
    empty = spark.createDataFrame([], timed.schema)
    schema = step(empty, None).schema
    stored = lambda session: session.read.schema(StructType([*schema.fields]).add("batch", "long")).option("basePath", target).parquet(target + "/batch=*")

    def write(batch: DataFrame, number: int) -> None:
        clock = batch.select("came_ms").first()
        found = stored(batch.sparkSession).filter((F.col("batch") < number) & F.expr(known) & (F.col("came_ms") + keep_ms > clock[0])) if number and clock else None
        step(batch, found).write.mode("overwrite").parquet(f"{target}/batch={number}")

    feed.run(timed.writeStream.foreachBatch(write).option("checkpointLocation", target + "-state"))
    return stored(spark).drop("batch", "came_ms")


def run_keyed(feed: Feed, stream: DataFrame, name: str, clock: bool = False) -> DataFrame:
    """`run_appends` for streams of `streaming.keyed`; `clock` for those whose state lives by the machine's time."""
    with settings(stream.sparkSession, KEYED_STORE | (NO_EMPTY_BATCHES if clock else {})):
        return run_appends(feed, stream, name)

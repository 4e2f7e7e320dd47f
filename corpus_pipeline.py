"""Five stages from raw documents to shards, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timedspark.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from timedspark.llm.common import table
from timedspark.llm.queries import OTHER_WEIGHT, WEIGHTS
from timedspark.operators.stage import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the classifier learns from the labels of the documents at hand.

    Null and empty texts stay. Rows that repeat are judged alike, each on its own. An empty table stays empty. Labels without
    a document, and null labels, teach nothing. Columns with names of the operator's own are kept as they are, here and in all stages.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays.

    A null doc_id counts as the largest. Null, empty and wordless texts are one class. Of rows that repeat a doc_id and its text one stays.
    An empty table stays empty.
    """
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null, empty and wordless texts stay, and so does everything where the benchmark is empty; null items match nothing. Rows that
    repeat go or stay together.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned until their sources have the target weights, then shuffled.

    Null sources are one source; a null or empty text weighs one unit. Rows that repeat a doc_id and its text draw alike. An empty
    table stays empty.
    """
    return mixing.mixed_documents(docs, WEIGHTS, OTHER_WEIGHT)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All copies get a shard of eight and a slot in it, in an order hashed from their place in the mix.

    Shards have near equal bytes, and copies of a text do not lie side by side. A null text weighs one byte. Rows that
    repeat have slots of their own. An empty table stays empty. A column named `shard` or `slot` is kept under a longer name.
    """
    return sharding.shard_in_random_order(docs, shards=8)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL cannot express the classifier and the signatures; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of `sf_dir`. Tables between stages lie in the session's shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.operators.stage import shared_folder

#: The characters between words once A-Z is lower-cased, and the same before.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes to word bytes: A-Z lower-cased, other ASCII outside [0-9a-z] a blank.
WORD_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from that copy.

    The folder is the session's `spark.checkpoint.dir`; only a local session without one gets a folder of its own.
    Spark deletes the copy with its DataFrame when `spark.cleaner.referenceTracking.cleanCheckpoints` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name beginning with `stem` that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def aside(df: DataFrame, *names: str) -> DataFrame:
    """Give columns that are named like results, in any case, a longer name."""
    for c in df.columns:
        if c.lower() in names:
            df = df.withColumnRenamed(c, fresh(df, c))
    return df


def as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The leading columns of `df`, which are those of `docs` in order, under their own names."""
    places = [f"_{k}" for k in range(len(df.columns))]
    return df.toDF(*places).select(*places[:len(docs.columns)]).toDF(*docs.columns)


def ascii_lower(word: Column) -> Column:
    """Lower-case A-Z only; words without capitals skip the slow translation."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, UPPER.lower()))


def raw_words(text: Column) -> Column:
    """Words of a text in their own case; a null or wordless text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_GAP), "")


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased."""
    return text.encode().translate(WORD_BYTES).split() if text else []

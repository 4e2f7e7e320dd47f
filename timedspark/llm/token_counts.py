"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timedspark.llm.common import cut

#: Fixed value: the split pattern that the byte-level vocabularies are made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str) -> bytes:
    """A rank file read on the driver (1 MB or so); it travels to the executors as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, vocabulary: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens of each whole text. Null and empty texts have none; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            lengths = pa.array([len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lengths], ["doc_id", "n_tokens"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(count, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(counts: DataFrame, length: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row per encoded length, with what suffix sums say of a context limit of that length.

    n_tokens; docs and tokens of that length; docs_longer and tokens_longer
    (strictly above it); docs_upto and quantile (the share of documents not above it);
    truncated_tokens: all tokens left when every document is cut at that length;
    dropped_tokens: those cut away; total_docs and total_tokens.

    Documents are added up by length before the shuffle, so a length that a third
    of the documents share is one row per task. Lengths are dealt by blocks: sums inside a block, and of
    whole blocks, are added. A null length counts as zero. An empty table gives an empty result.
    """
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    # Written once: the sums by block and those inside a block both start from it, and the texts are encoded once.
    bars = cut(counts.groupBy(n.alias("n_tokens")).agg(F.count("*").alias("docs"))).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    bars = bars.withColumn("_block", F.floor(F.col("n_tokens") / block))
    blocks = bars.groupBy("_block").agg(F.sum("docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    carried = blocks.select("_block", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}_above") for c in ("docs", "tokens")],
                            *[F.sum(f"_{c}").over(every).alias(f"total_{c}") for c in ("docs", "tokens")])
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = bars.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in ("docs", "tokens")]).join(carried, "_block")
    longer = sums.select("n_tokens", "docs", "tokens", *[(F.col(f"_{c}_inside") + F.col(f"_{c}_above")).alias(f"{c}_longer") for c in ("docs", "tokens")], "total_docs", "total_tokens")
    dropped = F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer")
    upto = F.col("total_docs") - F.col("docs_longer")
    return longer.select("n_tokens", "docs", "tokens", "docs_longer", "tokens_longer", upto.alias("docs_upto"), (upto / F.col("total_docs")).alias("quantile"),
                         (F.col("total_tokens") - dropped).alias("truncated_tokens"), dropped.alias("dropped_tokens"), "total_docs", "total_tokens")


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: context, docs_over, kept_tokens, dropped_tokens, whether or not a document has that length."""
    over = lambda x, c: F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col(c))), F.lit(0))
    wide = histogram.agg(F.array(*[F.struct(F.lit(x).cast("long").alias("context"), over(x, "docs").alias("docs_over"), over(x, "tokens").alias("over_tokens")) for x in sorted(set(limits))]).alias("rows"),
                         F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    rows = wide.select(F.explode("rows").alias("r"), "total")
    dropped = F.col("r.over_tokens") - F.col("r.context") * F.col("r.docs_over")
    return rows.select("r.context", "r.docs_over", (F.col("total") - dropped).alias("kept_tokens"), dropped.alias("dropped_tokens"))

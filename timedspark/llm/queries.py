"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedspark.llm import block_search, decontaminate, exact_dedup, hard_negatives, html_text, licences, mixing, near_dedup, oracle, prefix_trie, sharding, token_counts, toxicity, warc
from timedspark.llm.common import table

#: Target weights of the sources; the others have `OTHER_WEIGHT`.
WEIGHTS = {"src0": 1.0, "src1": 2.0, "src2": 2.0, "src3": 2.0, "src4": 0.5, "src5": 0.5}
OTHER_WEIGHT = 1.0
#: Rank file of the tokenizer; another path may be set in the session's `timedspark.tokenizer`.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_sampled_splitters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = sharding.shard_by_splitters(docs, shards=8)
    return out.select("doc_id", sharding.text_bytes(F.col("text")).alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_poisson_mixing(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf, "documents"), WEIGHTS, OTHER_WEIGHT)
    return out.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "rate", "copies", "copy", "mix_key")


def op3_quotient_filters(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf, "documents"))


def op4_licence_automaton(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf, "documents"))


def op5_tag_path_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf, "pages"))


def op6_positional_index(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.find_phrases(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_subsequence_kernel(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, table(spark, sf, "labels")).drop("text")


def op8_dart_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.mark_near_copies(table(spark, sf, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op9_chunked_records(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.archive_folder(spark)
    pages = table(spark, sf, "pages")
    warc.write_archives(pages, archives)
    kind = pages.schema["page_id"].dataType.simpleString()
    return warc.read_records(spark, archives).select(F.expr(f"try_cast(record AS {kind})").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                                                     F.expr(f"try_cast(refers_to AS {kind})").alias("refers_to"))


def op10_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(spark.conf.get("timedspark.tokenizer", VOCABULARY))
    return token_counts.length_histogram(token_counts.with_token_counts(table(spark, sf, "documents"), vocabulary))


def op11_radix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


def op12_vertical_scan(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_block_search(spark: SparkSession, sf: str) -> DataFrame:
    return block_search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sampled_splitters": op1_sampled_splitters,
    "op2_poisson_mixing": op2_poisson_mixing,
    "op3_quotient_filters": op3_quotient_filters,
    "op4_licence_automaton": op4_licence_automaton,
    "op5_tag_path_ratios": op5_tag_path_ratios,
    "op6_positional_index": op6_positional_index,
    "op7_subsequence_kernel": op7_subsequence_kernel,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_chunked_records": op9_chunked_records,
    "op10_length_histogram": op10_length_histogram,
    "op11_radix_trie": op11_radix_trie,
    "op12_vertical_scan": op12_vertical_scan,
    "op13_block_search": op13_block_search,
}

ORACLE: dict[str, str] = {
    "op2_poisson_mixing": oracle.poisson_mixing(WEIGHTS, OTHER_WEIGHT),
    "op3_quotient_filters": oracle.QUOTIENT_FILTERS,
    "op6_positional_index": oracle.POSITIONAL_INDEX,
    "op9_chunked_records": oracle.CHUNKED_RECORDS,
    "op11_radix_trie": oracle.PREFIX_TRIE,
    "op12_vertical_scan": oracle.HARD_NEGATIVES,
    "op13_block_search": oracle.BLOCK_SEARCH,
}

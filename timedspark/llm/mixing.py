"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.llm.common import as_before, aside, fresh

#: A larger mean is met by the sum of several draws, so that exp(-mean) stays a normal number.
MEAN_PER_DRAW = 64.0
#: Sources up to which their rates are broadcast (about 2 KB each); above it the join shuffles.
BROADCAST_SOURCES = 4096


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the seed and the keys' texts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(mean: Column) -> Column:
    """Distribution function of a Poisson number at 0, 1, ... as an array that ends where a double reaches one."""
    longest = F.ceil(mean + 12 * F.sqrt(mean)) + 20
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("steps"))

    def step(so_far: Column, k: Column) -> Column:
        p = so_far["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(so_far["steps"], F.element_at(so_far["steps"], -1) + p).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), longest), first, step, lambda x: x["steps"])


def source_rates(docs: DataFrame, weights: dict[str, float], other: float, source: str, size: Column, budget: float | None) -> DataFrame:
    """Mean repetitions of each source: its share of the budget over what it has.

    A source that `weights` does not name, null included, has the weight `other`.
    Shares are of the weights of the sources present. `budget` is in the unit of
    `size`; without it the budget is all that the table has.
    """
    have = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("available"))
    weight = F.lit(other)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    have = have.withColumn("weight", weight.cast("double"))
    sum_of_weights, all_there, n_sources = have.agg(F.sum("weight"), F.sum("available"), F.count("*")).first()
    target = budget if budget is not None else (all_there or 0.0)
    share = F.col("weight") * float(target) / F.lit(float(sum_of_weights or 1.0))
    have = F.broadcast(have) if n_sources <= BROADCAST_SOURCES else have
    return have.withColumn("rate", F.when(F.col("available") > 0, share / F.col("available")).otherwise(0.0))


def mix_sources(docs: DataFrame, weights: dict[str, float], other: float = 1.0, budget: float | None = None, source: str = "source",
                doc_id: str = "doc_id", text: str = "text", seed: int = 29) -> DataFrame:
    """Repeat each document by a Poisson number whose mean is its source's rate, then shuffle all copies.

    Adds `rate`, `copies`, `copy` (from 0) and `mix_key`, the place of the copy
    in the global shuffle: a number in [0, 1) from its keys. Copies are dealt
    out and sorted by it. Documents that draw zero are left out; a rate below
    one thins a source, a rate above one repeats it, and in the mean each source
    takes its weight's share of the budget in code points of text.

    The draw inverts the distribution function at a number hashed from the seed,
    the doc_id and the text, so it does not depend on the partitions, and rows that repeat
    a document draw alike. Null sources form a source of their own. Null and
    empty texts count one unit each, as every text counts its code points and
    one more. A source of weight zero goes. An empty table gives an empty
    result. Columns named like the added ones are kept under longer names.
    """
    docs = aside(docs, "rate", "copies", "copy", "mix_key")
    names, digest, steps, draws = docs.columns, fresh(docs, "_digest"), fresh(docs, "_steps"), fresh(docs, "_draws")
    rates = source_rates(docs, weights, other, source, F.coalesce(F.char_length(text), F.lit(0)) + 1, budget)
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PER_DRAW)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    rates = rates.select(F.col("source").alias("_source"), F.col("rate"), F.col("draws").alias(draws), poisson_steps(mean).alias(steps))

    joined = docs.select("*", F.md5(F.coalesce(text, F.lit(""))).alias(digest)).join(rates, F.col(source).eqNullSafe(F.col("_source")), "left")
    drawn = joined.withColumn(draws, F.transform(F.sequence(F.lit(1), F.col(draws)), lambda j: uniform(seed, F.col(doc_id), F.col(digest), j)))
    count = F.aggregate(F.col(draws), F.lit(0), lambda n, u: n + F.size(F.filter(F.col(steps), lambda step: step <= u)))
    counted = drawn.select(*names, digest, "rate", count.alias("copies"))
    copies = counted.select(*names, digest, "rate", "copies", F.explode(F.slice(F.sequence(F.lit(0), F.col("copies")), 1, F.col("copies"))).alias("copy"))
    placed = copies.select(*names, "rate", "copies", "copy", uniform(seed + 1, F.col(doc_id), F.col(digest), F.col("copy")).alias("mix_key"))
    return placed.repartition("mix_key").sortWithinPartitions("mix_key")



def mixed_documents(docs: DataFrame, weights: dict[str, float], other: float = 1.0, **options) -> DataFrame:
    """The copies in their global order, with the columns the documents came with."""
    return as_before(mix_sources(docs, weights, other, **options), docs)

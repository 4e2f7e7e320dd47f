"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedspark.llm.common import as_before, ascii_lower, aside, cut, fresh, raw_words

#: Rows up to which a side built from the benchmark, or the candidates, are broadcast (under 40 MB); above it the join shuffles.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, length: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of `length` words: window (hash), words, n, items (ids as strings, null as "null").

    An item of fewer words is one window; an item without words has none.
    """
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.transform(raw_words(F.col(text)), ascii_lower).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    windows = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), length).alias("words"))
    return (windows.groupBy("words").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64("words").alias("window"), "words", F.size("words").alias("n"), "items"))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every word of every text: key, pos from 0, term."""
    return docs.select(key, F.posexplode(raw_words(F.col(text))).alias("pos", "raw")).select(key, "pos", ascii_lower(F.col("raw")).alias("term"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int, key: str = "key", text: str = "text") -> DataFrame:
    """Positional index of `terms` over all texts: term, key, pos. Other words are dropped where they are read."""
    return tokens(docs, key, text).join(_small(terms, n_terms), "term")


def rarest_terms(windows: DataFrame, counts: DataFrame, most: int = 2) -> DataFrame:
    """The rarest `most` places of each window: window, n, term, offset, side (1, 2, 4 ...), need (the sum of the window's sides).

    Windows with a word that the training text lacks cannot occur and are left out.
    """
    places = windows.select("window", "n", F.posexplode("words").alias("offset", "term"))
    counted = places.join(counts, "term", "left")
    ranked = counted.groupBy("window", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "term"))).alias("ranked"))
    rare = F.slice("ranked", 1, most)
    return (ranked.where(F.col("ranked")[0]["df"] > 0)
            .select("window", "n", F.size(rare).alias("sides"), F.posexplode(rare).alias("k", "place"))
            .select("window", "n", "place.term", "place.offset", F.expr("shiftleft(1, k)").alias("side"), F.expr("shiftleft(1, sides) - 1").alias("need")))


def intersect(index: DataFrame, anchors: DataFrame, n_anchors: int, key: str = "key") -> DataFrame:
    """Offset-adjusted intersection: key, window, start where all the window's rarest terms stand at their places."""
    shifted = index.join(_small(anchors, n_anchors), "term").select(key, "window", (F.col("pos") - F.col("offset")).alias("start"), "side", "need").where("start >= 0")
    return (shifted.groupBy(key, "window", "start", "need").agg(F.bit_or("side").alias("sides"))
            .where("sides = need").select(key, "window", "start"))


def near(index: DataFrame, anchors: DataFrame, n_anchors: int, slop: int, key: str = "key") -> DataFrame:
    """Proximity: key, window, start, gap (not 0) where the two rarest terms stand up to `slop` words off their distance.

    Both lists are dealt by blocks of start places; the second is copied into the next blocks on either side.
    """
    shifted = index.join(_small(anchors, n_anchors), "term").select(key, "window", (F.col("pos") - F.col("offset")).alias("start"), "side")
    block = F.floor(F.col("start") / (slop + 1))
    one = shifted.where("side = 1").select(key, "window", "start", block.alias("block"))
    two = shifted.where("side = 2").select(key, "window", F.col("start").alias("other"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    gap = F.col("other") - F.col("start")
    return one.join(two, [key, "window", "block"]).select(key, "window", "start", gap.alias("gap")).where((F.col("gap") != 0) & (F.abs("gap") <= slop))


def _indexed(docs: DataFrame, items: DataFrame, length: int, key: str, text: str, item_id: str, item_text: str):
    windows = cut(item_windows(items, length, item_id, item_text))
    terms = windows.select(F.explode("words").alias("term")).distinct()
    counts = postings(docs, terms, terms.count(), key, text).groupBy("term").agg(F.count("*").alias("df"))
    anchors = cut(rarest_terms(windows, counts))
    n_anchors, n_terms = anchors.agg(F.count("*"), F.count_distinct("term")).first()
    index = cut(postings(docs.select(key, text), anchors.select("term").distinct(), n_terms, key, text))
    return windows, anchors, n_anchors, index


def find_phrases(docs: DataFrame, items: DataFrame, length: int = 10, text: str = "text", doc_id: str = "doc_id",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add n_words, n_hit, items (sorted ids as strings), n_items and contaminated to each document.

    A first pass counts the benchmark's words in all texts. The two rarest words
    of each window choose the postings that are stored; their lists, moved back by
    their offsets, are intersected, and each place found is compared with the
    whole window in the document's text. A word inside any occurrence is hit.

    Null and wordless texts have no words and are clean; null and wordless items
    match nothing. Rows that repeat are reported alike, each on its own. An empty
    table on either side gives no hits. Columns named like the results are kept
    under longer names.
    """
    docs = aside(docs, "n_words", "n_hit", "items", "n_items", "contaminated")
    names = docs.columns
    key, words, found = fresh(docs, "_key"), fresh(docs, "_words"), fresh(docs, "_found")
    keyed = docs.withColumn(key, F.xxhash64(doc_id, text))
    windows, anchors, n_anchors, index = _indexed(keyed, items, length, key, text, item_id, item_text)
    places = intersect(index, anchors, n_anchors, key)
    n_windows = windows.count()
    phrase = F.array_join("words", " ")
    places = cut(places.join(_small(windows, n_windows), "window")
                 .groupBy(key).agg(F.collect_list(F.struct("start", "n", phrase.alias("phrase"), "items")).alias(found)))
    n_places = places.agg(F.sum(F.size(found))).first()[0] or 0
    joined = keyed.join(_small(places, n_places), key, "left").withColumn(words, raw_words(F.col(text)))
    lower = F.transform(words, ascii_lower)
    same = lambda ws: lambda c: F.array_join(F.slice(ws, c["start"] + 1, c["n"]), " ") == c["phrase"]
    checked = joined.select(*names, F.size(words).cast("long").alias("n_words"), F.when(F.col(found).isNotNull(), F.struct(lower.alias("w"), F.col(found).alias("c"))).alias(found))
    checked = checked.withColumn(found, F.filter(F.col(found)["c"], same(F.col(found)["w"])))
    hit = F.array_distinct(F.flatten(F.transform(found, lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda c: c["items"]))))
    none = F.array().cast("array<string>")
    marked = checked.select(*names, "n_words", F.coalesce(F.size(hit), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, none).alias("items"), F.col(found).isNotNull().alias(found))
    return marked.select(*names, "n_words", F.when(F.col(found), F.col("n_hit")).otherwise(F.lit(0)).cast("long").alias("n_hit"), "items",
                         F.size("items").cast("long").alias("n_items"), (F.size("items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with the columns they came with."""
    return as_before(find_phrases(docs, items, **options).where("NOT contaminated"), docs)

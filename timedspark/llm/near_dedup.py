"""Near-duplicate detection by DartMinHash, banded joining and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timedspark.llm.common import WORD_BYTES, cut, fresh

#: Multipliers of a 64-bit mixing function.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd base of the rolling hash over bytes, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BANDS, ROWS = 28, 5
#: Distribution function of a Poisson number with mean 1, to the end of what a double tells apart.
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(18)])
UNIT = 1.0 / (1 << 53)
#: Rows up to which a list of identifiers or sets is broadcast.
BROADCAST_ROWS = 200_000
#: Rows up to which links and members of buckets are worked on in one partition (under 100 bytes each).
GATHERED = 200_000
#: Members of a bucket up to which it waits for the comparison of all pairs across classes; larger ones have rounds before it.
SMALL_BUCKET = 32
#: Members of each class that stand for it in a round over a larger bucket.
REPRESENTATIVES = 6
#: Members of a bucket that meet those of another block in one place when all pairs across classes are compared.
BLOCK = 256
#: Columns of a set's parity map: 64 bits each.
MAP = [f"map{k}" for k in range(16)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of the base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, INVERSE, np.uint64)])
        return self.up[:n], self.down[:n]


def shingles(text: str | None, powers: Powers, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct `width`-word shingles of a text, and how often each comes.

    A text of fewer words is one shingle; one without words has none. The hash of a shingle is a difference of prefix hashes.
    """
    joined = b" ".join(text.encode().translate(WORD_BYTES).split()) if text else b""
    if not joined:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.frombuffer(joined, np.uint8)
    up, down = powers.of(len(codes))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[codes] * up)])
    blanks = np.flatnonzero(codes == 32)
    starts, ends = np.r_[0, blanks + 1], np.r_[blanks, len(codes)]
    n = max(len(starts) - width + 1, 1)
    starts, ends = starts[:n], ends[min(width, len(ends)) - 1:]
    return np.unique(mix((prefix[ends] - prefix[starts]) * down[starts]), return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash: the dart with the earliest rank in each of `k` coordinates.

    The plane of weight and rank over an element is cut into cells of area 1: weight from 0 to 1, then from one power
    of two to the next, and rank in steps that make the area 1. A cell holds a Poisson number of darts at places hashed from element and cell; those
    below the element's weight hit. Ranks are searched up to a bound at which all coordinates are hit nearly surely; if one is not, the bound doubles.
    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    total = float(weights.sum())
    bound = k * (np.log(k) + 3) / total
    most = int(weights.max())
    while True:
        ranks, names = [], []
        for level in range(most.bit_length() + 1):
            low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
            if most <= low:
                break
            inside = slice(None) if level == 0 else weights > low
            steps = int(np.ceil(bound * (high - low)))
            cells = mix(np.arange(steps, dtype=np.uint64) * np.uint64(64) + np.uint64(level + 1))
            drawn = mix(elements[inside, None] ^ cells).ravel()
            count = np.searchsorted(POISSON, (drawn >> np.uint64(11)) * UNIT, side="right")
            cell = np.repeat(np.arange(len(drawn)), count)
            nth = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(drawn[cell] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
            rank = (cell % steps + (dart >> np.uint64(11)) * UNIT) / (high - low)
            hit = rank < bound
            heavy = weights[inside]
            if (heavy < high).any():
                at = low + (high - low) * ((mix(dart + np.uint64(1)) >> np.uint64(11)) * UNIT)
                hit &= at < heavy[cell // steps]
            ranks.append(rank[hit])
            names.append(dart[hit])
        rank, name = np.concatenate(ranks), np.concatenate(names)
        latest_first = np.argsort(-rank, kind="stable")
        name = name[latest_first]
        coordinate = mix(name + np.uint64(2)) % np.uint64(k)
        if np.bincount(coordinate.astype(np.int64), minlength=k).all():
            signature = np.zeros(k, np.uint64)
            signature[coordinate] = name  # of several darts in a coordinate the last one stays: the earliest
            return signature
        bound *= 2


def _signatures(bands: int, rows: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        multipliers = mix(np.arange(1, rows + 1, dtype=np.uint64))
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column("text"):
                elements, counts = shingles(text.as_py(), powers)
                weights = counts if weighted else np.ones_like(counts)
                nodes.append(hashlib.blake2b(elements.tobytes() + weights.tobytes(), digest_size=16).digest())
                sizes.append(int(weights.sum()))
                if len(elements):
                    signature = darts(elements, weights, bands * rows).reshape(bands, rows)
                    keys.append(mix((signature * multipliers).sum(1) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists],
                                             ["doc_id", "print", "node", "size", "bands"])
    return run


def _sets(weighted: bool):
    """node, its shingles as sorted 64-bit prints, their number n and parity map; a shingle that comes n times has n prints when weighted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            nodes, prints, sizes, maps = [], [], [], []
            for text in batch.column("text"):
                elements, counts = shingles(text.as_py(), powers)
                weights = counts if weighted else np.ones_like(counts)
                nodes.append(hashlib.blake2b(elements.tobytes() + weights.tobytes(), digest_size=16).digest())
                if weighted:
                    nth = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
                    elements = mix(np.repeat(elements, weights) + nth.astype(np.uint64))
                own = np.unique(elements)
                prints.append(own.tobytes())
                sizes.append(len(own))
                maps.append(np.packbits((np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * len(MAP)), minlength=64 * len(MAP)) & 1).astype(bool)).view(np.int64))
            words = np.array(maps, np.int64).reshape(-1, len(MAP))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), *map(pa.array, words.T.copy())],
                                             ["doc_id", "node", "prints", "n", *MAP])
    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("prints_a"), batch.column("prints_b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = 0 if min(len(x), len(y)) < least * max(len(x), len(y)) else len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))
    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingle_sets(given: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """node, prints, n and parity map of the wanted nodes (node, first: the doc_id whose text is read), written once for all comparisons."""
    wanted = cut(wanted.select("node", F.col("first").alias("doc_id")))
    sets = given.select("doc_id", "text").mapInArrow(_sets(weighted), f"doc_id {given.schema['doc_id'].dataType.simpleString()}, node binary, prints binary, n long, {', '.join(f'{m} long' for m in MAP)}").alias("s")
    w = _small(wanted, wanted.count()).alias("w")
    same = (F.col("s.node") == F.col("w.node")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))
    return cut(sets.join(w, same, "left_semi").select("node", "prints", "n", *MAP))


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs of nodes (a, b), those whose shingle sets are at least `least` similar."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("prints").alias("prints_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("prints").alias("prints_b")), "b").select("a", "b", "prints_a", "prints_b")
    return both.mapInArrow(_similar(least), "a binary, b binary").distinct()


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """`df` in one partition if it comes from at most GATHERED rows of names, so that steps over it need no shuffle; else as it is."""
    return df.coalesce(1) if rows <= GATHERED else df


def held(df: DataFrame, rows: int) -> DataFrame:
    """A written copy, in one partition if `gathered` says so. A copy that is read back does not tell its partitioning, so it is told again."""
    return gathered(cut(gathered(df, rows)), rows)


def components(links: DataFrame) -> DataFrame:
    """node, root of the connected parts of links (a, b), by alternating stars towards the smallest node."""
    rows = links.count()
    edges = held(gathered(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), rows).distinct(), rows)
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    mark = None
    while True:
        both = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.*").where("u != v").distinct()
        edges = held(small, rows)
        new = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new


def meetings(placed: DataFrame, mixed: DataFrame, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows of mixed buckets (with their largest class in `major`) at the places where they meet: those that roam, and those that stay.

    A bucket is dealt into blocks of about BLOCK nodes. Every node stays in its block; the nodes outside the largest class go to
    every block as well. So one outsider in a bucket of m nodes costs m / BLOCK rows and m comparisons, and a bucket at most about
    twice its pairs across classes.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    left = placed.join(_small(mixed.select("bucket", "major"), n_buckets), "bucket")
    stay = left.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    roam = left.where("root != major").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return roam, stay


def across(placed: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, int]:
    """Pairs (a, b) of nodes that share a bucket and not a class, from rows (bucket, node, members, root), and their number, repeats counted.

    Nodes meet in blocks (`meetings`), so no bucket is the work of one task. Pairs that cannot be
    `least` similar are left out by bounds that hold for certain: the sizes of the sets, and the bits in which their parity maps differ, which
    are never more than the shingles that only one of them has.
    """
    classes = placed.groupBy("bucket", "root").agg(F.count("*").alias("nodes")).groupBy("bucket").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("nodes", "root")).alias("major"))
    mixed = cut(classes.where("classes > 1"))
    roam, stay = (side.join(sets.select("node", "n", *MAP), "node").select("bucket", "block", "node", "root", "major", "n", *MAP) for side in meetings(placed, mixed, mixed.count()))
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block"))
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.root") < F.col("y.root"))
    sizes = F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")
    apart = sum((F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}"))) for m in MAP), F.lit(0))
    close = apart <= (1 - least) / (1 + least) * (F.col("x.n") + F.col("y.n")) + 1e-6
    met = cut(roam.alias("x").join(stay.alias("y"), meet & once & sizes & close).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")))
    return met, met.count()


def class_members(given: DataFrame, least: float, weighted: bool, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents' nodes (doc_id, print, node, size), and node, root of every node that is linked to another."""
    kind = given.schema["doc_id"].dataType.simpleString()
    signed = cut(given.mapInArrow(_signatures(bands, rows, weighted), f"doc_id {kind}, print long, node binary, size long, bands array<bigint>"))
    nodes = cut(signed.where("size(bands) > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("members")).where("members > 1")
    shared = cut(buckets.join(leaders, "bucket").select("bucket", "node", "b", "members"))
    n_shared = shared.count()
    shared = held(shared, n_shared) if n_shared <= GATHERED else shared
    sets = shingle_sets(given, nodes.join(shared.select("node").distinct(), "node", "left_semi"), weighted)
    # First a node meets the smallest leader of all its buckets, which joins most of a large group by one pair a node.
    tested = held(shared.groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b")).where("a != b"), n_shared)
    links = held(verify(tested, sets, least), n_shared)
    roots = components(links)

    def apart(pairs: DataFrame, n_pairs: int) -> DataFrame:
        """Pairs not tested yet whose nodes are in different classes."""
        one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
        placed = gathered(pairs, n_pairs).distinct().join(one, "a", "left").join(two, "b", "left").where(~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b")))
        return held(placed.select("a", "b").join(tested, ["a", "b"], "left_anti"), n_pairs)

    def placed_members() -> DataFrame:
        return shared.join(roots, "node", "left").select("bucket", "node", "members", F.coalesce("root", "node").alias("root"))

    # Rounds that join classes by few pairs, so that little is left for the whole comparison after them.
    turn = 0
    while True:
        if turn == 0:
            # The leaders of a node's other buckets, where these have stayed apart from it.
            found = apart(shared.where("node != b").select(F.col("node").alias("a"), "b"), n_shared)
        else:
            # Some of each class of a large bucket meet one of its nodes: first the one whose buckets hold most nodes, as the original of edited copies, then any.
            large = placed_members().where(F.col("members") > SMALL_BUCKET)
            orders = [F.xxhash64("node", F.lit(REPRESENTATIVES * turn + k)) for k in range(REPRESENTATIVES)]
            some = [F.min_by("node", o) for o in orders]
            if turn == 1:
                large = large.join(shared.groupBy("node").agg(F.sum("members").alias("reach")), "node")
                widest = F.struct("reach", "node")
                chosen = large.groupBy("bucket", "root").agg(F.array_distinct(F.array(F.max_by("node", widest), *some)).alias("some"), F.max(widest).alias("widest"))
                head = F.max("widest")["node"]
            else:
                chosen = large.groupBy("bucket", "root").agg(F.array_distinct(F.array(*some)).alias("some"))
                head = F.min(F.array_min("some"))
            chosen = held(chosen, n_shared)
            heads = chosen.groupBy("bucket").agg(head.alias("b"), F.count("*").alias("classes")).where("classes > 1")
            pairs = chosen.join(heads, "bucket").select(F.explode("some").alias("a"), "b").where("a != b")
            found = apart(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n_shared)
        more = held(verify(found, sets, least), n_shared)
        tested = held(tested.union(found), n_shared)
        if not more.isEmpty():
            links = held(links.union(more), n_shared)
            roots = components(links)
        elif turn:
            break
        turn += 1
    # Every pair of a bucket whose nodes are in different classes is now compared. Classes only grow, so no pair turns up after this.
    pairs, n_pairs = across(placed_members(), sets, least)
    if n_pairs:
        more = held(verify(apart(pairs, n_pairs), sets, least), n_pairs)
        if not more.isEmpty():
            roots = components(links.union(more))
    return signed.select("doc_id", "print", "node", "size"), roots


def mark_near_copies(docs: DataFrame, least: float = 0.8, weighted: bool = False, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size, kept, print (hash of the text).

    Texts are sets of five-word shingles, or bags of them when `weighted`; two are linked if the (weighted) Jaccard similarity is `least` or more. Texts
    with one set are one node from the start, so a group of copies costs one node. Each bucket of a band links its members to its smallest
    node, pairs are verified on the whole sets, links make classes, and rounds of few pairs join classes until no new link turns up. Then every pair
    of a bucket that is in two classes is compared, whatever the bucket's size; pairs within a class never are. At 0.8 a pair shares no band with probability 1.5e-5.

    Null, empty and wordless texts form one class of their own. The row with the smallest doc_id (null last) stays; of rows that repeat it, one.
    An empty table gives an empty result; other columns are not read.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    members, roots = class_members(given, least, weighted, bands, rows)
    placed = members.join(roots, "node", "left").select("doc_id", "print", "node", F.coalesce("root", "node").alias("root"))
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    twin = F.row_number().over(Window.partitionBy("doc_id", "root").orderBy("print"))
    joined = placed.withColumn("twin", twin).join(classes, "root")
    return joined.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("twin") == 1)).alias("kept"), "print")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, with all their columns: one of each class."""
    marks = mark_near_copies(docs, text=text, doc_id=doc_id, **options)
    keys = cut(marks.groupBy(F.col("doc_id").alias("_gone"), F.col("print").alias("_print")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    n_gone, again = keys.agg(F.count_if(~F.col("kept")), F.coalesce(F.bool_or(F.col("kept") & (F.col("n") > 1)), F.lit(False))).first()
    gone = keys.where("NOT kept").select("_gone", "_print")
    own = fresh(docs, "_own")
    printed = docs.withColumn(own, F.xxhash64(text))
    same = F.col(own).eqNullSafe(F.col("_print")) & F.col(doc_id).eqNullSafe(F.col("_gone"))
    left = printed.join(_small(gone, n_gone), same, "left_anti")
    # Rows that repeat a doc_id and its text cannot be told apart by these; only where there are some is the text dealt out.
    return (left.dropDuplicates([doc_id, own]) if again else left).drop(own)

"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, joined along their edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedspark.llm.common import cut

#: Bytes of a turn id: the head of the SHA-256 of a turn, big end first.
WIDTH = 16
#: A tree holds so many conversations, or so many bytes of keys, before the next one begins.
TREE_ROWS = 1 << 16
TREE_BYTES = 32 << 20
#: Turns a conversation may take over from the first one of its hundred.
MOST_HEAD = 5
#: Nodes on the edges of trees up to which they are broadcast (at most 40 bytes each).
BROADCAST_ROWS = 100_000

NODES = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, node binary, parent binary, ids string, ids_from long")
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- the tree -------------------------------------------------------------------------------------------------------

class Sorted:
    """Node layout of up to 16 children: their bytes and the children, side by side; first for 4, then for 16."""

    __slots__ = ("room", "marks", "kids")

    def __init__(self, room: int = 4):
        self.room, self.marks, self.kids = room, bytearray(), []

    def find(self, byte: int) -> Node | None:
        at = self.marks.find(byte)
        return self.kids[at] if at >= 0 else None

    def add(self, byte: int, kid: Node) -> Layout:
        if len(self.kids) < self.room:
            at = sum(mark < byte for mark in self.marks)
            self.marks.insert(at, byte)
            self.kids.insert(at, kid)
            return self
        wider: Layout = Sorted(16) if self.room == 4 else Indexed()
        for mark, old in zip(self.marks, self.kids):
            wider = wider.add(mark, old)
        return wider.add(byte, kid)

    def in_order(self) -> list[Node]:
        return self.kids


class Indexed:
    """Node layout of up to 48 children: 256 places of one byte that point into the children."""

    __slots__ = ("places", "kids")

    def __init__(self):
        self.places, self.kids = bytearray(256), []

    def find(self, byte: int) -> Node | None:
        return self.kids[self.places[byte] - 1] if self.places[byte] else None

    def add(self, byte: int, kid: Node) -> Layout:
        if len(self.kids) < 48:
            self.kids.append(kid)
            self.places[byte] = len(self.kids)
            return self
        wider = Full()
        for mark, place in enumerate(self.places):
            if place:
                wider.add(mark, self.kids[place - 1])
        return wider.add(byte, kid)

    def in_order(self) -> list[Node]:
        return [self.kids[place - 1] for place in self.places if place]


class Full:
    """Node layout of up to 256 children, one place for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids: list[Node | None] = [None] * 256

    def find(self, byte: int) -> Node | None:
        return self.kids[byte]

    def add(self, byte: int, kid: Node) -> Layout:
        self.kids[byte] = kid
        return self

    def in_order(self) -> list[Node]:
        return [kid for kid in self.kids if kid is not None]


Layout = Sorted | Indexed | Full


class Node:
    """A compressed stretch of bytes, the conversations that end after it, and the children by their next byte."""

    __slots__ = ("prefix", "layout", "ends", "lens", "sums")

    def __init__(self, prefix: bytes):
        self.prefix, self.layout, self.ends, self.lens, self.sums = prefix, Sorted(), None, None, None


def common(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class RadixTree:
    """Adaptive radix tree from keys of whole turn ids to the conversations that have them."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, conv: int, lens: list[int]) -> None:
        if self.root is None:
            self.root = Node(key)
        node, at = self.root, 0
        while True:
            same = common(node.prefix, key[at:at + len(node.prefix)])
            if same < len(node.prefix):  # the stretch is cut in two
                lower = Node(node.prefix[same + 1:])
                lower.layout, lower.ends, lower.lens = node.layout, node.ends, node.lens
                node.layout = Sorted().add(node.prefix[same], lower)
                node.prefix, node.ends, node.lens = node.prefix[:same], None, None
            at += same
            if at == len(key):
                node.ends = node.ends or []
                node.ends.append(conv)
                node.lens = lens
                return
            kid = node.layout.find(key[at])
            if kid is None:
                kid = Node(key[at + 1:])
                node.layout = node.layout.add(key[at], kid)
                kid.ends, kid.lens = [conv], lens
                return
            node, at = kid, at + 1


class Sums:
    """What a subtree passes up: members, smallest member, and counts of what begins in this tree."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "lens", "first", "last", "rows")

    def __init__(self):
        self.n, self.low, self.kids, self.leaves, self.saved = 0, None, 0, 0, 0
        self.lens, self.first, self.last, self.rows = None, False, False, []

    def take(self, other: Sums) -> None:
        self.n += other.n
        self.low = other.low if self.low is None else min(self.low, other.low)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.lens, self.first, self.last = self.lens or other.lens, self.first or other.first, self.last or other.last
        self.rows += other.rows


def prefix_names(key: bytes, turns: int) -> list[bytes]:
    """Names of the prefixes of 0, 1, ... `turns` turns of a key."""
    running, names = hashlib.sha256(), []
    for k in range(turns + 1):
        names.append(running.copy().digest())
        running.update(key[WIDTH * k:WIDTH * (k + 1)])
    return names


def digest_of(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def tree_nodes(rows: list[tuple[bytes, int, list[int]]], before: int, after: int) -> list[list]:
    """Nodes, in the columns of NODES, of the sorted conversations (key, conv_id, lengths of its turns).

    `before` and `after` say how many turns the first key shares with the key before the rows, and the last with the
    key after them, or -1 where there is none. A node within that share is on the edge: other trees have it as
    well, so it gets a name and its counts hold only what begins here (a node, child or length where it comes first, a
    leaf where it comes last); they add up over trees. All other nodes are whole.
    """
    tree = RadixTree()
    for row in rows:
        tree.insert(*row)
    names = prefix_names(rows[0][0], before) if before >= 0 else []
    names_after = prefix_names(rows[-1][0], after) if after >= 0 else []
    out: list[list] = []
    order, stack = [], [(tree.root, 0)]
    while stack:
        node, at = stack.pop()
        order.append((node, at))
        below = at + len(node.prefix) + 1
        stack += [(kid, below) for kid in reversed(node.layout.in_order())]
    first_end = next(node for node, _ in order if node.ends)
    last_end = next(node for node, _ in reversed(order) if node.ends)

    def emit(depth: int, s: Sums, ends: list[int] | None) -> None:
        """The node of `depth` turns that holds all of `s`; `s` becomes what it passes up."""
        old, open_ = s.first and depth <= before, s.last and depth <= after
        length = s.lens[depth - 1] if depth else 0
        leaf = not s.rows and not open_
        s.saved += s.n * length - (0 if old else length)
        s.leaves += leaf
        edge = old or open_
        name = None if not edge else names[depth] if old else names_after[depth]
        row = [depth, s.low, None, s.n, s.kids, s.leaves, s.saved, None if edge else digest_of(ends) if ends else NO_ENDS, name, None,
               ",".join(map(str, ends)) if edge and ends else None, ends[0] if edge and ends else None]
        for kid in s.rows:
            if edge:
                kid[9] = name
            else:
                kid[2] = s.low
        out.append(row)
        s.rows, s.kids = [row], 0 if old else 1

    for node, at in reversed(order):
        s, end = Sums(), at + len(node.prefix)
        for kid in node.layout.in_order():
            s.take(kid.sums)
            kid.sums = None
        if node.ends:
            s.n, s.low = s.n + len(node.ends), node.ends[0] if s.low is None else min(s.low, node.ends[0])
            s.lens = s.lens or node.lens
            s.first, s.last = s.first or node is first_end, s.last or node is last_end
        depth, over = divmod(end, WIDTH)
        if not over:
            emit(depth, s, node.ends)
            depth -= 1
        while WIDTH * depth >= at and depth >= 0:
            emit(depth, s, None)
            depth -= 1
        node.sums = s
    return out


# --- Spark ----------------------------------------------------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    """Hex turn id; the length of the role keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (turn, id, length) in order of the turn, null first, then of the id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_id(role, text).alias("id"), F.char_length(text).alias("n")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation with the head of the first of its hundred: conv_id, turns.

    The first h turns come from conversation c - c % 100, the rest are its own after its first h; h is the CRC-32 of the
    decimal conv_id modulo 6. `%` keeps the sign of c, as in SQL.
    """
    own = ordered_turns(conversations)
    heads = ordered_turns(conversations.filter("conv_id % 100 = 0")).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, following = batch.column("last").to_pylist(), batch.column("following").to_pylist()
        turns = [-1 if b is None else common(a, b) // WIDTH for a, b in zip(last, following)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("next_part"), pa.array(turns, pa.int32())], ["part", "next_part", "turns"])


def _trees(before: dict[int, int], after: dict[int, int], tree_rows: int):
    """Trees of a sorted partition, one after the other."""
    schema = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in NODES.split(", "))])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, list[int]]]:
        for batch in batches:
            yield from zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("lens").to_pylist())

    def packed(nodes: list[list]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(nodes), 8_192):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes[k:k + 8_192]), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        share, held, size = before.get(part, -1), [], 0
        for row in rows_of(batches):
            if len(held) >= tree_rows or size >= TREE_BYTES:
                shared = common(held[-1][0], row[0]) // WIDTH
                yield from packed(tree_nodes(held, share, shared))
                share, held, size = shared, [], 0
            held.append(row)
            size += len(row[0])
        if held:
            yield from packed(tree_nodes(held, share, after.get(part, -1)))
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of each node, which come in order, joined by commas; only the running digest is held."""
    current, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for node, ids in zip(batch.column("node"), batch.column("ids")):
            name = node.as_py()
            if name == current:
                running.update(b",")
            else:
                if running is not None:
                    done.append((current, running.hexdigest()))
                current, running = name, hashlib.sha256()
            running.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is the byte string of its turn ids. Byte strings are sorted over the cluster; each task builds adaptive
    radix trees (4, 16, 48 and 256 children a node, compressed paths) over `tree_rows` of them at a time and reads off the
    nodes at depths of whole turns. A tree shares nodes with others only along its two edges. These are named by the
    SHA-256 of their prefix and added up; their number is twice the depth for each tree. Everything else is final where it
    was made. A conversation that a third of all rows repeat is cut over tasks like any other range; its list of ends
    is hashed in order, block of ids by block.

    A null role or text is an empty one; a null turn comes first, equal turns of a conversation in order of their ids; repeated
    rows are repeated turns. Rows without a conv_id belong to no conversation. An empty table has no node,
    not even a root. Other columns do not matter. A turn counts whole, however long its text; of a conversation a task
    holds 16 bytes and a length for each turn, not the texts.
    """
    turns = rebuilt_conversations(conversations)
    keyed = turns.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), "conv_id", F.transform("turns", lambda t: t["n"]).alias("lens"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"))

    ends = sorted_.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"), F.max("key").alias("last"))
    across = Window.orderBy("part")  # one row for each partition
    shares = (ends.select("part", "last", F.lead("part").over(across).alias("next_part"), F.lead("first").over(across).alias("following"))
              .mapInArrow(_shares, "part int, next_part int, turns int").filter("next_part IS NOT NULL").collect())
    after, before = {r["part"]: r["turns"] for r in shares}, {r["next_part"]: r["turns"] for r in shares}

    nodes = cut(sorted_.mapInArrow(_trees(before, after, tree_rows), NODES))
    whole, edge = nodes.filter("node IS NULL"), nodes.filter("node IS NOT NULL")
    digests = (edge.filter("ids IS NOT NULL").select("node", "ids_from", "ids").repartition("node").sortWithinPartitions("node", "ids_from")
               .mapInArrow(_digests, "node binary, ends_sha256 string"))
    merged = cut(edge.groupBy("node").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in (
        "n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("parent").alias("parent")).join(digests, "node", "left"))
    upper = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper"))
    if merged.count() <= BROADCAST_ROWS:
        upper = F.broadcast(upper)

    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = whole.filter("parent IS NULL").select(shown)
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent"]
    outer = (whole.filter("parent IS NOT NULL").select(columns)
             .unionByName(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(columns))
             .join(upper, "parent", "left").withColumnRenamed("upper", "parent_conv_id"))
    return inner.unionByName(outer.select(shown))

"""Prefix trie against plain Python, and its radix tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from timedspark.llm import prefix_trie
from timedspark.llm.prefix_trie import Full, Indexed, Sorted

SCHEMA = "conv_id long, turn long, role string, text string, Depth int, node string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows):
    """Nodes by going through every prefix of every rebuilt conversation."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = (role or "", text or "")
            name = hashlib.sha256(f"{len(key[0])}:{key[0]}{key[1]}".encode()).hexdigest()[:32]
            turns[c].append(((turn is not None, turn or 0), name, key))
    own = {c: [key for _, _, key in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        whole = tuple(own.get(c - base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, convs in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(convs) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in kids
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def shown(frame):
    return sorted(tuple(-1 if r[f] is None else r[f] for f in FIELDS) for r in frame.collect())


def some_rows(seed, convs=260):
    """Few texts, so that conversations share much; a third of them are the same; one is long; some turns are null or equal."""
    rng, rows = random.Random(seed), []
    for c in range(-5, convs):
        if c % 3 == 0:
            rows += [(c, k, "user", f"same {k}", 1, "x") for k in range(7)]
        else:
            rows += [(c, rng.choice([k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bb", "ccc"]), 1, "x") for k in range(rng.randrange(9))]
    rows += [(1_000, k % 50, "user", f"turn {k}", None, None) for k in range(700)] + [(None, 1, "user", "lost", 1, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tree_rows", [1, 20])
def test_against_all_prefixes(spark, table, tree_rows):
    rows = some_rows(tree_rows)
    assert shown(prefix_trie.prefix_trie(table(rows, SCHEMA), tree_rows)) == trie(rows)


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert shown(prefix_trie.prefix_trie(frame, 7)) == trie([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_empty_long_and_turnless(spark, table):
    assert prefix_trie.prefix_trie(table([], SCHEMA)).collect() == []
    lone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1][0]
    rows = [(lone, 0, "user", "x", 1, "x"), (300, 0, "user", "long " * 200_000, 1, "x"), (301, 1, "user", "long " * 200_000, 1, "x")]
    out = shown(prefix_trie.prefix_trie(table(rows, SCHEMA)))
    assert out == trie(rows) and (lone, 0, -1, 3) in [r[:4] for r in out]


def test_broadcast_and_shuffled_edges_agree(spark, table, monkeypatch):
    rows = some_rows(5, 90)
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", -1)
    assert shown(prefix_trie.prefix_trie(table(rows, SCHEMA), 2)) == trie(rows)


def test_layouts_grow():
    tree, keys = prefix_trie.RadixTree(), [bytes([k]) + bytes(15) for k in range(256)]
    seen = []
    for n, key in enumerate(keys):
        tree.insert(key, n, [1])
        seen.append((type(tree.root.layout), getattr(tree.root.layout, "room", 0)))
    assert [seen[k] for k in (3, 15, 40, 255)] == [(Sorted, 4), (Sorted, 16), (Indexed, 0), (Full, 0)]
    assert [kid.ends for kid in tree.root.layout.in_order()] == [[n] for n in range(256)]
    assert tree.root.prefix == b"" and tree.root.layout.find(7).prefix == bytes(15)


def test_stretch_is_cut_in_the_middle_of_a_turn():
    a, b = b"aaaabbbbccccdddd" * 2, b"aaaabbbbccccdddd" + b"aaaabbbbccccdddX"
    nodes = prefix_trie.tree_nodes([(b, 2, [3, 4]), (a, 1, [3, 5])], -1, -1)
    assert sorted((n[0], n[1], n[3], n[4], n[5], n[6]) for n in nodes) == [(0, 1, 2, 1, 2, 3), (1, 1, 2, 2, 2, 3), (2, 1, 1, 0, 1, 0), (2, 2, 1, 0, 1, 0)]

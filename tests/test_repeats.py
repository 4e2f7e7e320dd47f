"""Phrase search against a search that compares every window."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from timedspark.functions.text import similarity, similarity_bound
from timedspark.operators import repeats as Q
from timedspark.plans import bind

SYLLABLES = "ka lo mi ren tas ul vor esh in da".split()


def best_windows(rows, phrases, length, minimum):
    """(media_id, seq, ratio) of the earliest best window, from all of them."""
    out = []
    for media, phrase in phrases:
        words = sorted((seq, text) for m, seq, _, text in rows if m == media)
        rated = [(SequenceMatcher(None, " ".join(t for _, t in words[k:k + length]), phrase).ratio(), -seq) for k, (seq, _) in enumerate(words)]
        if rated and max(rated)[0] >= minimum:
            out.append((media, -max(rated)[1], round(max(rated)[0], 9)))
    return sorted(out)


def test_phrases_of_random_recordings(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    rows = [(m, 3 * k, 100 * k, word()) for m in range(4) for k in range(900)]
    phrases = [(m, " ".join(word() for _ in range(3))) for m in range(4)] + [(9, "nothing here at all")]
    frame, wanted = spark.createDataFrame(rows, "media_id long, seq long, start_ms long, text string"), spark.createDataFrame(phrases, "media_id long, phrase string")
    got = sorted((r["media_id"], r["seq"], round(r["ratio"], 9)) for r in Q.locate_phrase(frame, wanted, 3).collect())
    assert got == best_windows(rows, phrases, 3, 0.5)


def test_phrases_of_the_table(spark):
    """Same onsets as comparing every window of the driver's table, of which less than a fifth are compared."""
    from timedspark.functions.text import skeleton
    w = bind.words(spark, "/root/testdata/sf0.001").select("media_id", "turn", "pos", "seq", "start_ms", "text")
    words = [(r["media_id"], r["seq"], r["start_ms"], r["t"]) for r in w.withColumn("t", skeleton("text")).collect()]
    heads = sorted((r["media_id"], r["pos"], r["t"]) for r in w.filter("turn = 1 AND pos < 3").withColumn("t", skeleton("text")).collect())
    phrases = [(m, " ".join(t for n, _, t in heads if n == m)) for m in sorted({m for m, _, _ in heads})]
    wanted = spark.createDataFrame(phrases, "media_id long, phrase string")
    windows = Q.phrase_windows(w, wanted, 3, 0.5)
    left = Q.contenders(windows, 0.5).count()
    got = sorted((r["media_id"], r["seq"], round(r["ratio"], 9)) for r in Q.locate_phrase(w, wanted, 3).collect())
    assert got == best_windows(words, phrases, 3, 0.5)
    assert left < 0.2 * len(words)


def test_bound_is_never_below_the_ratio(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abc d") for _ in range(rng.randrange(12)))
    rows = [(text(), text()) for _ in range(3_000)] + [("", ""), (None, "a"), ("a", None)]
    frame = spark.createDataFrame(rows, "a string, b string").select(similarity("a", "b").alias("r"), similarity_bound("a", "b").alias("u"))
    assert frame.filter("u < r OR (u IS NULL) <> (r IS NULL)").count() == 0


def clusters(rows, threshold=0.55):
    """(media_id, line, leader) by comparing every line with every leader."""
    out, heads = {}, {}
    for media, seq, line in sorted(rows):
        if len(line.split(" ")) >= 3 and (media, line) not in out:
            similar = [at for at, head in heads.setdefault(media, []) if SequenceMatcher(None, line, head).ratio() >= threshold]
            out[media, line] = similar[0] if similar else seq
            if not similar:
                heads[media].append((seq, line))
    return out


def test_clusters_of_random_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(2, 7))) for _ in range(120)]
    rows = [(k % 3, k, rng.choice(texts)) for k in range(900)]
    frame = spark.createDataFrame(rows, "media_id long, seq long, text string")
    assert {(r["media_id"], r["norm"]): r["leader"] for r in Q.line_clusters(frame).collect()} == clusters(rows)


def test_clusters_and_refrains_of_the_table(spark):
    from collections import Counter
    from timedspark.functions.text import skeleton
    from timedspark.plans.source_queries import sung_lines
    lines = sung_lines(spark, "/root/testdata/sf0.001")
    rows = [(r["media_id"], r["seq"], r["t"]) for r in lines.withColumn("t", skeleton("text")).collect()]
    want = clusters(rows)
    assert {(r["media_id"], r["norm"]): r["leader"] for r in Q.line_clusters(lines).collect()} == want
    sizes = Counter((m, want[m, line]) for m, _, line in rows if (m, line) in want)
    best = {m: min((-n, leader) for (other, leader), n in sizes.items() if other == m) for m, _ in sizes}
    assert sorted(tuple(r) for r in Q.refrains(lines).collect()) == sorted((m, leader, -n) for m, (n, leader) in best.items() if n <= -2)


def test_few_leaders_are_compared():
    """Lines in different letters: the bound leaves the leaders of the own kind, and finds the same as a full comparison."""
    rng = random.Random(6)
    kinds = ["abcdefg", "hijklmn", "opqrstu", "vwxyz01"]
    lines = ["".join(rng.choice(rng.choice(kinds) if k % 50 == 0 else kinds[k % 4]) for _ in range(rng.randrange(10, 30))) for k in range(600)]
    leaders, heads = Q.Leaders(0.55), []
    for line in lines:
        found = leaders.find(line)
        full = next((k for k, head in enumerate(heads) if SequenceMatcher(None, line, head).ratio() >= 0.55), None)
        assert found == full
        if found is None:
            leaders.add(line)
            heads.append(line)
    assert leaders.compared < 0.3 * len(lines) * len(heads)

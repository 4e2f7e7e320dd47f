"""Repeated lines and phrase search in sung or spoken transcripts."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedspark.functions.text import similarity, similarity_bound, skeleton
from timedspark.operators.fold import streaming_fold
from timedspark.operators.scan import Axis, scan, total
from timedspark.operators.sequence import rolling
from timedspark.operators.stage import stage

#: Words of a block of phrase windows.
BLOCK_WORDS = 4_096
#: Columns of letter counts of a line.
COLUMNS = 64


def repeated_lines(lines: DataFrame, min_count: int = 2) -> DataFrame:
    """Exactly repeated lines per recording: count and first position. `norm` is the compared text."""
    return (lines.groupBy("media_id", "norm").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
            .filter(F.col("n") >= min_count))


class Leaders:
    """Lines that head a cluster, in order, with the counts of their letters in COLUMNS columns.

    The letters that two lines have in common, wherever they stand, bound their matching blocks from above, and
    letters that share a column only loosen the bound. So `candidates` never leaves out a leader that is similar enough.
    """

    def __init__(self, threshold: float):
        self.threshold, self.lines, self.compared = threshold, [], 0
        self.counts, self.lengths = np.zeros((64, COLUMNS), np.int32), np.zeros(64)

    @staticmethod
    def letters(line: str) -> np.ndarray:
        return np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) % COLUMNS, minlength=COLUMNS).astype(np.int32)

    def candidates(self, line: str) -> np.ndarray:
        n = len(self.lines)
        common = np.minimum(self.counts[:n], self.letters(line)).sum(axis=1)
        return np.flatnonzero(2 * common >= self.threshold * (self.lengths[:n] + len(line)) - 1e-9)

    def find(self, line: str) -> int | None:
        """Number of the first leader whose matching-block ratio reaches the threshold."""
        matcher = SequenceMatcher(None)
        matcher.set_seq1(line)
        for k in self.candidates(line).tolist():
            self.compared += 1
            matcher.set_seq2(self.lines[k])
            if matcher.ratio() >= self.threshold:
                return k
        return None

    def add(self, line: str) -> None:
        n = len(self.lines)
        if n == len(self.lengths):
            self.counts, self.lengths = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.counts[n], self.lengths[n] = self.letters(line), len(line)
        self.lines.append(line)


def line_clusters(lines: DataFrame, threshold: float = 0.55, min_words: int = 3) -> DataFrame:
    """(media_id, norm, leader, n, first_seq): each line joins the first cluster whose leader is similar.

    Equal lines always land in one cluster, so each distinct line is compared
    once, in order of first appearance, and only with leaders that share enough letters.
    """
    def start():
        leaders, places = Leaders(threshold), []

        def step(seq, norm):
            found = leaders.find(norm)
            if found is not None:
                return (places[found],)
            leaders.add(norm)
            places.append(seq)
            return (seq,)
        return step

    plain = lines.withColumn("norm", skeleton("text"))
    worded = plain.filter(F.size(F.split("norm", " ")) >= min_words)
    distinct = worded.groupBy("media_id", "norm").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return streaming_fold(distinct, ["media_id"], ["first_seq"], ["first_seq", "norm"], start, "leader BIGINT")


def refrains(lines: DataFrame, threshold: float = 0.55, min_words: int = 3) -> DataFrame:
    """The largest cluster of at least two lines per recording; the earliest leader wins a tie."""
    clusters = line_clusters(lines, threshold, min_words).groupBy("media_id", "leader").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", (-F.col("leader")).alias("l")))
    return (clusters.groupBy("media_id").agg(best.alias("b")).filter("b.n >= 2")
            .select("media_id", (-F.col("b.l")).alias("leader"), F.col("b.n").alias("n")))


def phrase_windows(words: DataFrame, phrases: DataFrame, length: int, minimum: float) -> DataFrame:
    """Windows of `length` words that can reach `minimum`, written once: media_id, __block, seq, start_ms, window, phrase, bound.

    The bound counts the letters that window and phrase have in common, wherever they stand; matching blocks have no more.
    """
    plain = words.withColumn("__w", skeleton("text"))
    numbered = stage(scan(plain, Axis(("media_id",), ("seq",), BLOCK_WORDS), __i=total(F.lit(1).cast("bigint"))))
    run = F.collect_list(F.struct("__i", "__w"))
    spans = rolling(numbered, Axis(("media_id",), ("__i",), BLOCK_WORDS), 0, length - 1, __run=run)
    window = F.array_join(F.transform(F.array_sort("__run"), lambda r: r["__w"]), " ")
    bounded = (spans.join(phrases, "media_id").select("media_id", F.floor(F.col("__i") / BLOCK_WORDS).alias("__block"), "seq", "start_ms", window.alias("window"), "phrase")
               .withColumn("bound", similarity_bound("window", "phrase")))
    return stage(bounded.filter(F.col("bound") >= minimum))


def contenders(windows: DataFrame, minimum: float) -> DataFrame:
    """The windows that can still be the best of their recording.

    Of each block the window with the highest bound is compared first. What the best of them reaches is a floor for
    the recording, and only windows whose bound reaches the floor remain.
    """
    heads = windows.groupBy("media_id", "__block").agg(F.max_by(F.struct("window", "phrase"), F.struct("bound", -F.col("seq"))).alias("h"))
    rated = heads.select("media_id", similarity("h.window", "h.phrase").alias("ratio"))
    floors = rated.groupBy("media_id").agg(F.greatest(F.max("ratio"), F.lit(minimum)).alias("floor"))
    return windows.join(floors, "media_id").filter(F.col("bound") >= F.col("floor")).drop("floor")


def locate_phrase(words: DataFrame, phrases: DataFrame, length: int, minimum: float = 0.5) -> DataFrame:
    """Onset of the best match of a phrase of `length` words per recording; the earliest on a tie.

    `phrases`: (media_id, phrase), already in skeleton form. The matching-block ratio is computed for windows whose
    upper bound reaches what another window of the recording has reached already; no other can be the best.
    """
    rated = contenders(phrase_windows(words, phrases, length, minimum), minimum).withColumn("ratio", similarity("window", "phrase"))
    best = F.max_by(F.struct("seq", "start_ms", "ratio"), F.struct("ratio", -F.col("seq")))
    return rated.groupBy("media_id").agg(best.alias("b")).filter(F.col("b.ratio") >= minimum).select("media_id", "b.*")

"""Reply extraction, gates and scoring."""

import json

import pytest
from pyspark.sql import functions as F

from timedspark.functions import extract as E
from timedspark.functions import text as T
from timedspark.functions.numeric import round_exact
from timedspark.operators import replies as M
from timedspark.operators import scoring as A

ARRAYS = [('[{"a": 1}]', [{"a": 1}]), ('```json\n[{"a": 1}]\n```', [{"a": 1}]), ("```\n[1, 2]\n```", [1, 2]), ("[1] and more ] text", [1]),
          ("Here: [3]", [3]), ("nothing", None), ("[1, ", None), ("[]", [])]


def test_leading_array(table):
    df = table([(i, raw) for i, (raw, _) in enumerate(ARRAYS)], "i INT, raw STRING")
    got = {r.i: r.j for r in df.select("i", E.leading_array(F.col("raw")).alias("j")).collect()}
    for i, (_, want) in enumerate(ARRAYS):
        assert (None if got[i] is None else json.loads(got[i])) == want


def test_flat_object_returns_inner_object_on_nesting(table):
    df = table([('note {"a": {"b": 1}} end',), ('{"a": {"b": 1}}',), ("none",)], "raw STRING")
    got = [r[0] for r in df.select(E.flat_object(F.col("raw"))).collect()]
    assert got == ['{"b": 1}', '{"a": {"b": 1}}', None]


def test_coerce_rules(table):
    rows = [("ok", "10", "40", " A  title. ", "r", "2"), ("clamp", "-5", "30", None, None, None), ("short", "0", "14.9", "t", "", "1"),
            ("long", "0", "90.1", "t", "", "1"), ("edge", "0", "90", "t", "", "1"), ("nan", "NaN", "40", "t", "", "1"), ("bad", "0", "40", "t", "", "high"),
            ("inf", "0", "Infinity", "t", "", "1")]
    df = table(rows, "k STRING, start STRING, end STRING, title STRING, reason STRING, hook_score STRING")
    got = {r.k: r for r in M.coerce_clips(df, F.lit(100_000).cast("bigint")).collect()}
    assert set(got) == {"ok", "clamp", "edge"}
    assert got["ok"].title == "A title" and got["ok"].hook_score == 1.0
    assert got["clamp"].title == "Clip 0-30" and got["clamp"].hook_score == 0.5


GOOD = {"opening_clear": True, "payoff_complete": True, "title_supported": True, "opening_context": "x", "title": "A fine short title",
        "title_evidence": "one  two", "payoff_evidence": "three"}


def reviewed(table, *attempts, latin=False):
    rows = [("k", i + 1, "one two three", a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(attempts)]
    out = M.review(table(rows, "key STRING, attempt INT, excerpt STRING, raw STRING"), ["key"], latin).first()
    return out.outcome, out.title


@pytest.mark.parametrize("change,want", [
    ({}, "accepted"), ({"reject": True}, "rejected"), ({"opening_clear": False}, "rejected"), ({"payoff_complete": "true"}, "review_failed"),
    ({"opening_clear": None, "payoff_complete": False}, "review_failed"), ({"title_evidence": "four"}, "review_failed"),
    ({"opening_context": " "}, "review_failed"), ({"title": "Two words"}, "review_failed"), ({"title": "one two three four five six seven eight"}, "title_too_long")])
def test_review_outcomes(table, change, want):
    assert reviewed(table, {**GOOD, **change})[0] == want


def test_review_retry_and_script(table):
    long = {**GOOD, "title": "one two three four five six seven eight"}
    assert reviewed(table, long, GOOD) == ("accepted", "A fine short title")
    assert reviewed(table, long, long)[0] == "review_failed"
    assert reviewed(table, GOOD, {**GOOD, "reject": True})[0] == "accepted"
    assert reviewed(table, {**GOOD, "title": "एक छोटा शीर्षक"}, latin=True)[0] == "title_too_long"


def corrected(table, raw, texts=("a", "b", "c"), **options):
    words = table([("m", 0, i, i * 100, i * 100 + 90, t, 1.0 - i / 10) for i, t in enumerate(texts)],
                  "media_id STRING, chunk BIGINT, i INT, start_ms BIGINT, end_ms BIGINT, text STRING, confidence DOUBLE")
    replies = table([("m", 0, raw if isinstance(raw, str) else json.dumps(raw))], "media_id STRING, chunk BIGINT, raw STRING")
    fixed, judged = M.apply_corrections(words, replies, **options)
    return judged.first().ok, [(r.text, r.start_ms, r.end_ms) for r in fixed.orderBy("item", "part").collect()]


def item(indices, *out):
    return {"source_indices": indices, "words": list(out)}


def test_corrections(table):
    ok, rows = corrected(table, {"corrections": [item([0, 1], "ab"), item([2], "x", "yyy")]})
    assert ok and rows == [("ab", 0, 190), ("x", 200, 223), ("yyy", 223, 290)]
    for bad in ({"corrections": [item([0], "a"), item([2], "c")]}, {"corrections": [item([1], "a"), item([0], "b"), item([2], "c")]},
                {"corrections": [item([0, 1, 2], "two words")]}, {"corrections": [item([0, 1, 2], "x")], "extra": 1}, "not json",
                {"corrections": [item([0], "a"), item([1], "b"), item([2], "")]}, {"corrections": []}):
        assert corrected(table, bad) == (False, [])
    assert corrected(table, {"corrections": [item([0, 1], "ab"), item([2], "c")]}, spelling=False)[0] is False
    assert corrected(table, {"corrections": [item([0], "नम"), item([1], "b"), item([2], "c")]})[0] is False


def test_verdicts_and_ranges(table):
    secs = [(24.9, 0.5), (25.0, 1.0), (60.0, 1.0), (60.1, 0.5)]
    zero = F.lit(0.0)
    got = table([(s,) for s, _ in secs], "s DOUBLE").select(A.tech_score(zero, zero, zero, F.col("s"), F.lit(9.0), zero).alias("t")).collect()
    assert [round(r.t, 4) for r in got] == [round(v * 0.15 + 0.075, 4) for _, v in secs]
    rates = [(1.4, 0.5), (1.5, 1.0), (3.5, 1.0), (3.6, 0.5)]
    got = table([(s,) for s, _ in rates], "s DOUBLE").select(A.tech_score(zero, zero, zero, F.lit(1.0), F.col("s"), zero).alias("t")).collect()
    assert [round(r.t, 4) for r in got] == [round(v * 0.15 + 0.075, 4) for _, v in rates]


def test_rounding_follows_the_exact_binary_value(table):
    import random
    rng = random.Random(4)
    values = [0.575, 2.675, 1.005, 0.285, 0.125, 0.375, 2.5, -0.575, 0.0, 4.35] + [rng.randrange(10_000) / 2_000 for _ in range(300)]
    got = table([(v,) for v in values], "v DOUBLE").select("v", round_exact(F.col("v"), 2).alias("r"), round_exact(F.col("v"), 1).alias("s")).collect()
    assert [(r.r, r.s) for r in got] == [(round(r.v, 2), round(r.v, 1)) for r in got]


def test_text_rules(table):
    df = table([("  Big  idea!? ",), ("A/B: test_case — Ünïted",), ("***",)], "t STRING")
    assert [r[0] for r in df.select(T.normalise_title(F.col("t"))).collect()][0] == "Big idea"
    assert [r[0] for r in df.select(T.slug(F.col("t"))).collect()] == ["big-idea", "ab-test-case-ünïted", "clip"]
    assert [r[0] for r in df.select(T.skeleton("t")).collect()][1] == "ab testcase  united"


def test_scorer_runs_over_prompts(table):
    prompts = table([("a", "s", "u1"), ("b", "s", "u2")], "key STRING, system_prompt STRING, user_prompt STRING")
    got = {r.key: r.raw for r in M.score_with(prompts, lambda s, u: s + u).collect()}
    assert got == {"a": "su1", "b": "su2"}
    tries = table([("a", 1, "x"), ("a", 2, ""), ("b", 1, "")], "key STRING, attempt INT, raw STRING")
    assert [tuple(r) for r in M.latest_good(tries, ["key"], F.lit(True)).collect()] == [("a", 1, "x")]


def test_tags_by_hash(spark, table):
    """The first spelling of each, fifteen at most, in order; the tags of one text are not compared one with another."""
    texts = [" ".join(f"W{i % 40}!" if i % 3 else f"w{i % 40}" for i in range(3_000)), "a A b. , B# a_", "", "!! ??", None, "x" * 9 + " é1 1"]
    df = table([(t,) for t in texts], "t string").select(T.clean_tags(F.split("t", " ")).alias("tags"))

    def want(text):
        kept = []
        for tag in ("#" + "".join(c for c in word if c.isascii() and (c.isalnum() or c == "_")) for word in text.split(" ")):
            if len(tag) > 1 and tag.lower() not in [k.lower() for k in kept] and len(kept) < 15:
                kept.append(tag)
        return kept
    assert [r[0] for r in df.collect()] == [None if t is None else want(t) for t in texts]
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_prompt_lines_without_a_formatter(table):
    """The same text as the formatter gives, also for odd times; it is left for negative ones."""
    from timedspark.operators import replies as M
    times = [0, 4, 5, 14, 15, 994, 995, 999, 1_000, 59_994, 59_995, 9_999_994, 9_999_995, 123_456_785, -5, -1_234, None]
    df = table([(t, 0) for t in times], "start_ms long, z int").select(M._seconds("start_ms"), F.format_string("%7.2f", F.col("start_ms") / 1_000))
    for got, formatted in df.collect():
        assert got == formatted


def test_prompt_lines_are_made_per_word(table):
    """The number of a line is all that a clip adds to the text of a word."""
    from timedspark.operators import replies as M
    words = M.spoken_lines(table([(1, 5, 900, 1_415, "b"), (1, 4, 0, 896, "a")], "media_id long, seq long, start_ms long, end_ms long, text string"))
    context = words.withColumn("clip", F.lit(3)).withColumn("idx", F.col("seq") - 4).select("media_id", "clip", "idx", "spoken")
    assert M.context_prompt(context, ["media_id", "clip"]).first()["prompt"] == "  [   0]    0.00-   0.90  a\n  [   1]    0.90-   1.42  b"

"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from timedspark.llm import decontaminate, exact_dedup, html_text, licences, mixing, near_dedup, sharding, token_counts, toxicity, warc
from timedspark.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, Score double, items string, _key long, rate double"
LONG = "word " * 60_000
ROWS = [(1, "one two three four five six", "en", "a", 27, "x", 0.5, "i", 1, 2.0), (2, None, None, None, None, None, None, None, None, None),
        (None, "one two three four five six", "en", "a", 27, "x", 0.5, "i", 1, 2.0), (3, "", "en", "b", 0, "x", 0.5, "i", 1, 2.0),
        (4, LONG, "de", "b", 300_000, "x", 0.5, "i", 1, 2.0), (4, LONG, "de", "b", 300_000, "x", 0.5, "i", 1, 2.0), (5, "?!", "de", "b", 2, "x", 0.5, "i", 1, 2.0),
        (None, None, None, None, None, None, None, None, None, None), (6, "idiot " * 3, "en", "a", 18, "x", 0.5, "i", 1, 2.0)]
LABELS = "doc_id long, toxic int"
ITEMS = [(7, "two three four"), (8, None), (None, "nothing here"), (9, ""), (7, "two three four")]


@pytest.fixture(params=["rows", "empty"])
def docs(request, table):
    return table(ROWS if request.param == "rows" else [], DOCS)


@pytest.fixture
def labels(table):
    return table([(1, 0), (6, 1), (6, None), (None, 1), (3, 0)], LABELS)


@pytest.fixture
def items(table):
    return table(ITEMS, "item_id long, text string")


def test_sharding(docs):
    n = docs.count()
    out = sharding.shard_by_splitters(docs, shards=3).collect()
    assert len(out) == n and all(r["shard_"] in ("x", None) for r in out)
    for k in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_mixing(docs):
    out = mixing.mix_sources(docs, {"a": 2.0}, 1.0, budget=4000.0).collect()
    assert all(0 <= r["copy"] < r["copies"] and 0 <= r["mix_key"] < 1 for r in out)
    if docs.count():
        assert {r["source"] for r in out} == {"a", None} and {r["rate_"] for r in out} == {2.0, None}
        weightless = mixing.mix_sources(docs, {"a": 0.0}, 0.0).count()
        assert weightless == 0


def test_exact_dedup(docs):
    out = exact_dedup.mark_copies(docs).collect()
    assert len(out) == docs.count()
    if out:
        groups = {}
        for r in out:
            groups.setdefault(r["text_sha256"], []).append(r)
        assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in groups.values())
        assert sorted((r["doc_id"] or 0, r["kept"]) for r in out if r["keep_id"] == 1) == [(0, False), (1, True)]


def test_licences(docs):
    out = licences.scan_licences(docs).collect()
    assert len(out) == docs.count() and all(r["labels"] == "" and r["first_word"] is None and r["score"] == 0 for r in out)


def test_html(table):
    pages = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "plain words", "x"), (2, "u", "plain words", "x"), (3, "u", "<p>" * 3000 + "deep", "x"), (4, "u", "<!x <", "x")]
    out = html_text.extract_main_text(table(pages, "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in out][:5] == ["", "", "plain words", "plain words", "deep"] and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract_main_text(table([], "page_id long, url string, html string")).count() == 0


def test_decontamination(docs, items, table):
    out = decontaminate.find_phrases(docs, items, length=3).collect()
    assert len(out) == docs.count()
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["items"]) for r in out if r["contaminated"]) == ([(0, 3, ["7"]), (1, 3, ["7"])] if out else [])
    assert all(r["items_"] in ("i", None) for r in out)
    assert decontaminate.find_phrases(docs, table([], "item_id long, text string")).where("contaminated").count() == 0


def test_toxicity(docs, labels, table):
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    assert toxicity.score_toxicity(docs, table([], LABELS)).where("predicted = 1").count() == 0


def test_near_dedup(docs):
    out = near_dedup.mark_near_copies(docs).collect()
    assert len(out) == docs.count()
    if out:
        classes = {}
        for r in out:
            classes.setdefault(r["class_id"], []).append(r)
        assert all(sum(r["kept"] for r in c) == 1 and {r["class_size"] for r in c} == {len(c)} for c in classes.values())
        assert sorted(len(c) for c in classes.values()) == [1, 2, 2, 4]
    assert sorted(near_dedup.drop_near_copies(docs).columns) == sorted(docs.columns)


def test_archives(table, spark):
    pages = [(1, None, None, "x"), (2, "u v", "", "x"), (3, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "x"), (3, "u", "é" * 300_000, "x"), (None, "u", "é" * 300_000, "x"), (4, "u", "\n\n", "x"), (5, "u", "\r\n", "x")]
    path = warc.archive_folder(spark)
    warc.write_archives(table(pages, "page_id long, url string, html string, kind string"), path)
    out = {(r["record"], r["payload_bytes"]): r for r in warc.read_records(spark, path).collect()}
    assert len(out) == 7 and all(r["intact"] for r in out.values())
    assert out["1", 0]["kind"] == "revisit" and out["1", 0]["refers_to"] == "2" and out["2", 0]["kind"] == "response"
    assert out["null", 600_000]["refers_to"] == "3" and out["3", 600_000]["kind"] == "response"
    chunks = warc.read_chunks(spark, path).where("record = '3' AND n_bytes > 1000").orderBy("chunk").collect()
    assert [c["chunk"] for c in chunks] == [0, 1] and [c["last"] for c in chunks] == [False, True]
    empty = warc.archive_folder(spark)
    warc.write_archives(table([], "page_id long, url string, html string"), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_token_counts(docs):
    counts = token_counts.with_token_counts(docs, token_counts.read_vocabulary(VOCABULARY))
    out = token_counts.length_histogram(counts).collect()
    assert sum(r["docs"] for r in out) == docs.count()
    assert [r["context"] for r in token_counts.answer_limits(token_counts.length_histogram(counts), [0, 10]).collect()] == [0, 10]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(name, stage, docs, labels, items, table, spark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    if name == "sharding":
        assert out.columns[-2:] == ["shard", "slot"] and out.count() == docs.count()
    else:
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out")

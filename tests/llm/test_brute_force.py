"""Operators against plain Python on small tables."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from timedspark.llm import decontaminate, exact_dedup, html_text, licences, mixing, near_dedup, sharding, token_counts, toxicity
from timedspark.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_shards_are_even_and_keep_small_groups(spark):
    rows = [(k, "hot " * 50 if k % 3 == 0 else f"text {k % 600} " * (1 + k % 40)) for k in range(3000)]
    out = sharding.shard_by_splitters(spark.createDataFrame(rows, "doc_id long, text string"), shards=5, whole_group=0.02).collect()
    size, groups = Counter(), defaultdict(set)
    for r in out:
        size[r["shard"]] += len(r["text"]) + 1
        groups[r["text"]].add(r["shard"])
    mean = sum(size.values()) / 5
    assert all(abs(n - mean) < 0.03 * mean for n in size.values())
    assert len(groups["hot " * 50]) > 1 and sum(len(s) > 1 for s in groups.values()) == 1


def test_mixing_meets_weights(spark):
    rows = [(k, "x" * 9, "a" if k % 10 else "b") for k in range(20_000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 1.0, "b": 3.0}).collect()
    got = Counter(r["source"] for r in out)
    assert abs(got["a"] / 5_000 - 1) < 0.06 and abs(got["b"] / 15_000 - 1) < 0.06
    copies = Counter(Counter(r["doc_id"] for r in out if r["source"] == "b").values())
    assert abs(copies[8] / 2_000 - 0.1366) < 0.03  # a Poisson number with mean 7.5 is 8 that often
    assert mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 0.0, "b": 1.0}, budget=4_000_000.0).count() == pytest.approx(400_000, rel=0.02)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 500, 1_000).astype(np.uint64) for _ in range(4)]
    merged = exact_dedup.merge_filters([exact_dedup.build_filter(p) for p in parts])
    whole = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged[0] == whole[0]).all() and (merged[1] == whole[1]).all()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, docs, texts, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "one two"), (901, "the")], "item_id long, text string"))
    windows = defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 9)):
            windows[tuple(w[k:k + 10])].add(str(r["item_id"]))
    for r in decontaminate.find_phrases(docs, items).collect():
        w, hit, ids = words(texts[r["doc_id"]]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(ids))


def test_proximity(spark):
    index = spark.createDataFrame([("a", 1, 5), ("b", 1, 8), ("a", 2, 5), ("b", 2, 6), ("a", 3, 5), ("b", 3, 50)], "term string, key long, pos int")
    anchors = spark.createDataFrame([(7, 2, "a", 0, 1, 3), (7, 2, "b", 1, 2, 3)], "window long, n int, term string, offset int, side int, need int")
    assert [tuple(r) for r in decontaminate.intersect(index, anchors, 2).collect()] == [(2, 7, 5)]
    assert [tuple(r) for r in decontaminate.near(index, anchors, 2, 3).collect()] == [(1, 7, 5, 2)]


def brute_classes(texts, least=0.8):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    names = list(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if (not x and not y) or len(x & y) >= least * len(x | y) > 0:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("gathered", [200_000, 0])
def test_near_copies(spark, monkeypatch, gathered):
    monkeypatch.setattr(near_dedup, "GATHERED", gathered)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))] for _ in range(40)]
    rows, k = [], 0
    for text in base:
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((k, " ".join(copy)))
            k += 1
    chain = [f"c{j}" for j in range(60)]
    for j in range(12):
        rows.append((k + j, " ".join(chain[j * 2:] + [f"d{i}" for i in range(j * 2)])))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(dict(rows))


@pytest.mark.parametrize("small, block, gathered", [(1, 16, 200_000), (32, 256, 0)])
def test_near_copies_in_large_buckets(spark, monkeypatch, small, block, gathered):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "GATHERED", gathered)
    rng, rows = random.Random(11), []
    for star in range(2):
        original = [f"s{star}x{j}" for j in range(204)]
        rows.append((1_000 * star + 500, " ".join(original)))
        for k in range(200):
            copy = list(original)
            for j, at in enumerate(rng.sample(range(10, 195, 6), 4)):
                copy[at] = f"new{star}x{k}x{j}"
            rows.append((1_000 * star + k, " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(dict(rows)) and len(set(got.values())) == 2


def test_pairs_across_classes_come_once_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rows = [(b, bytes([k]), 60 - 10 * b, bytes([k // 3 if b < 2 else 0])) for b in range(3) for k in range(60 - 10 * b)]
    alike = [(bytes([k]), 100, *[k] * len(near_dedup.MAP)) for k in range(60)]
    sets = spark.createDataFrame(alike, "node binary, n long, " + ", ".join(f"{m} long" for m in near_dedup.MAP))
    pairs, n = near_dedup.across(spark.createDataFrame(rows, "bucket long, node binary, members long, root binary"), sets, 0.05)
    got = Counter((bytes(r["a"]), bytes(r["b"])) for r in pairs.collect())
    want = Counter((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3] and x[1] > y[1])
    assert got == want and n == sum(want.values())


def test_near_copies_of_the_table(docs, texts):
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_dedup.mark_near_copies(docs).collect()}
    want = brute_classes(texts)
    assert got == {k: (c, k == c) for k, c in want.items()}
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_copies(docs).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("heavy", [False, True])
def test_darts_estimate_similarity(heavy):
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    a = rng.integers(1, 9, 300) if heavy else np.ones(300, np.int64)
    b = np.maximum(1, a + rng.integers(-1, 2, 300)) if heavy else a
    x, y = slice(0, 270), slice(30, 300)
    both = np.minimum(a[30:270], b[30:270]).sum()
    want = both / (a[x].sum() + b[y].sum() - both)
    got = (near_dedup.darts(elements[x], a[x], 3_000) == near_dedup.darts(elements[y], b[y], 3_000)).mean()
    assert abs(got - want) < 0.04


def test_licences(texts):
    finder = licences.automaton()
    for text in [*texts.values(), "Under the MIT license, under the MIT-License. CC BY-NC cc by cc by nc"]:
        w, places, labels = words(text), [], set()
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        n, n_base, first, last, base, every, score = licences.scan_text(text, finder)
        assert (n, n_base, first, last, base) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(every.split(",")) | {""} and 0 <= score <= 1


@pytest.mark.parametrize("text, want", [
    (b"MIT", {"mit"}), (b"(MIT OR Apache-2.0) AND GPL-2.0-only", {"mit", "apache-2", "gpl-2"}), (b"GPL-2.0 WITH Classpath-exception-2.0 */", {"gpl-2 with classpath-exception-2"}),
    (b"MIT AND", {"mit"}), (b"(MIT", None), (b"OR", None), (b"cc-by-nc-4.0", {"cc-by-nc"}), (b"A or B and C with d", {"a", "b", "c with d"})])
def test_expressions(text, want):
    assert licences.expression_labels(text) == want


@pytest.mark.parametrize("text, want", [
    (b"The license is described below", None), (b"MIT for the code, see LICENSE", {"mit"}), (b"MIT or the other", {"mit"}), (b"MIT.", {"mit"}), (b"apache-2.0+", {"apache-2"}),
    (b"LicenseRef-Mine AND DocumentRef-a:LicenseRef-b", {"licenseref-mine", "documentref-a:licenseref-b"}), (b"GPL-3.0-or-later WITH care", {"gpl-3"}),
    (b"GPL-2.0-only WITH GCC-exception-3.1 WITH GCC-exception-3.1", {"gpl-2 with gcc-exception-3.1"}), (b"(MIT OR ISC) WITH GCC-exception-3.1", {"mit", "isc"}),
    (b"Python is a language", None), (b"Python-2.0", {"python-2"}), (b"() MIT", None), (b"", None)])
def test_identifiers_are_known_ones(text, want):
    assert licences.expression_labels(text, licences.is_identifier) == want


def test_long_expressions_take_linear_time():
    many = b" or ".join(b"LicenseRef-%d" % k for k in range(50_000))
    assert len(licences.expression_labels(many, licences.is_identifier)) == 50_000
    nested = b"(MIT or " * 50_000 + b"ISC" + b")" * 50_000
    assert licences.expression_labels(nested, licences.is_identifier) == {"mit", "isc"}
    half = b"(" + b" or ".join(b"LicenseRef-%d" % k for k in range(2_000)) + b")"
    assert len(licences.expression_labels(half + b" with " + half, licences.is_identifier)) == 2_000
    started = time.monotonic()
    licences.scan_text("SPDX-License-Identifier: " + nested.decode(), licences.automaton())
    assert time.monotonic() - started < 5


def test_tags_are_read():
    got = licences.scan_text("# SPDX-License-Identifier: MIT OR BSD-3-Clause\nx", licences.automaton())
    assert got[5] == "bsd-3-clause,mit" and got[6] > 0.99


PARAGRAPHS = ["First of the story, with some words. It goes on; and on, for a while.", "Another one here, quite long too. With more sentences, commas, and so on.", "Short one.",
              "The last of the main text ends, as all must, with a full stop."]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("html", [
    f'<body><header><h1>Site</h1></header><div id="content">{ARTICLE}</div><div class="sidebar"><p>Side text, with words. More.</p></div><footer>f</footer></body>',
    f'<body><div class="cookie-notice">We use cookies, ok?</div><main><article>{ARTICLE}<section class="comments"><p>Great post, thanks a lot. Really.</p></section></article></main></body>',
    f'<body><article>{ARTICLE}</article><section><h3>Comments</h3><div><p>Great post, thanks a lot. I agree, really.</p></div></section></body>',
    f'<body><table><tr><td class="menu">a b c</td><td>{ARTICLE}</td></tr></table><script>var x = "<p>no, no. no</p>";</script></body>',
    f'<body><article>{ARTICLE}<form><p>Email, please. Subscribe now, today.</p></form></article><aside>More, more. More.</aside></body>',
    f'<body><div id="main">{"".join(f"<div>{p}</div>" for p in PARAGRAPHS)}</div><div class="footer">Foot, all rights. Res.</div></body>'])
def test_pages(html):
    assert html_text.main_text(html) == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("wrapper", ['class="row no-sidebar"', 'id="page" class="has-sidebar"', 'class="with-comments"', 'id="share-legal"', 'id="social"', 'class="search-page"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_named_like_side_parts(wrapper, tag):
    html = f'<body><nav>a b</nav><div {wrapper}><{tag}>{ARTICLE}</{tag}><div class="sidebar"><p>Side text.</p></div></div><div class="footer">Foot.</div></body>'
    assert html_text.main_text(html) == "\n\n".join(PARAGRAPHS)


def test_articles_among_comments_stay_aside():
    comments = f'<div id="comments"><article class="comment-body">{ARTICLE}{ARTICLE}</article></div>'
    assert html_text.main_text(f"<body><main>{ARTICLE}</main>{comments}</body>") == "\n\n".join(PARAGRAPHS)
    assert html_text.main_text(f'<body><div class="entry">{ARTICLE}</div>{comments}</body>') == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("broken", ["<![foo[ x>", "<![ 5 ]>", "<![endif-->", "<![>", "<![if !IE]>", "<![CDATA[a > b]]>", "<![CDATA[ x>", "<!foo [ x>"])
def test_text_after_broken_declarations(broken):
    assert html_text.main_text(f"<body><article><p>One, two. Three.</p>{broken}<p>Four, five. Six.</p></article></body>") == "One, two. Three.\n\nFour, five. Six."


def test_all_chosen_text_is_kept():
    long = "".join(f"<p>{p}</p>" for p in PARAGRAPHS * 12)
    lead = "The lead, which says it all, and more. It is read first, of course, by everyone here."
    want = "\n\n".join(["Title", lead, *PARAGRAPHS * 12])
    assert html_text.main_text(f"<body><nav>a b</nav><div><h1>Title</h1><p>{lead}</p><div class=entry>{long}</div></div><footer>f</footer></body>") == want
    for around in ("main", "div"):
        parts = f"<article>{ARTICLE}{ARTICLE}</article><article>{ARTICLE}</article>"
        assert html_text.main_text(f"<body><{around}>{parts}</{around}><div>Unnamed, after it. So.</div></body>") == "\n\n".join(PARAGRAPHS * 3)
    assert html_text.main_text(f"<body><div><p>{lead}</p><article>{ARTICLE}</article></div></body>") == "\n\n".join([lead, *PARAGRAPHS])


def test_blocks_and_references():
    html = "<nav>x, y. z</nav><article><h1>A&amp;B &lt;x&gt;</h1><p><b>line one,<br>line  two.<p>three, &eacute;. four</article>"
    assert html_text.main_text(html) == "A&B <x>\n\nline one, line two.\n\nthree, é. four"


def test_histogram(spark, docs, texts):
    encode = token_counts.encoder(token_counts.read_vocabulary(VOCABULARY)).encode_ordinary
    lengths = sorted(len(encode(t)) for t in texts.values())
    histogram = token_counts.length_histogram(token_counts.with_token_counts(docs, token_counts.read_vocabulary(VOCABULARY)))
    for r in histogram.collect():
        n = r["n_tokens"]
        assert (r["docs"], r["docs_longer"], r["docs_upto"]) == (lengths.count(n), sum(x > n for x in lengths), sum(x <= n for x in lengths))
        assert (r["truncated_tokens"], r["total_tokens"]) == (sum(min(x, n) for x in lengths), sum(lengths))
    for r in token_counts.answer_limits(histogram, [0, 100, 777, 10 ** 6]).collect():
        assert r["kept_tokens"] == sum(min(x, r["context"]) for x in lengths) and r["docs_over"] == sum(x > r["context"] for x in lengths)


def test_toxicity_holds_out_and_tolerates_disguise(spark):
    rng = random.Random(2)
    bad = ["idiot", "moron", "worthless", "scumbag"]
    rows, labels = [], []
    for k in range(1_500):
        text = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un", "so"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 60))]
        toxic = k % 4 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text).capitalize() + "."))
        labels.append((k, int(toxic)))
    disguised = {5_000: "lo mi i-d-i-o-t ka ter i-d-i-o-t", 5_001: "so un w o r t h l e s s ka lo w o r t h l e s s", 5_002: "ka mor.on lo, MORON!! mi"}
    docs = spark.createDataFrame(rows + list(disguised.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(out[k]["predicted"], y) for k, y in labels if out[k]["held_out"]]
    assert 200 < len(held) < 400 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(out[k]["predicted"] == 1 for k in disguised)
    near, far = toxicity.forms("i.d-iot"), toxicity.forms("the")
    assert near == ["i.d-iot", "idiot"] and far == ["the"]


def test_toxic_words_count_as_often_as_they_come():
    class Known(toxicity.Memory):
        def __init__(self, model):
            self.known = dict.fromkeys([*(f"bad{k}" for k in range(40)), "idiot"], 0.5) | dict.fromkeys(["fine", *"idot"], -0.5)

        def of(self, sets):
            return self.known

    def mass(*texts):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "Memory", Known)
            batch = pa.RecordBatch.from_pydict({"text": list(texts)})
            return np.expm1(next(toxicity._measures(None)(iter([batch]))).column(toxicity.MEASURES[1]).to_pylist())
    kinds = lambda n: " ".join(f"bad{k}" for k in range(n) for _ in range(50)) + " fine"
    assert np.allclose(mass(kinds(10), kinds(19), kinds(20), kinds(40), "i d i o t idiot", "fine", ""), [250, 475, 500, 1000, 1, 0, 0])


def test_contracted_columns(spark):
    want = {"op1": "doc_id size text_crc32 law shard slot grown_shard", "op3": "doc_id keep_id group_size kept text_sha256", "op5": "page_id url text n_chars",
            "op4": "doc_id n_words n_base first_word last_word base_labels labels score", "op9": "page_id payload_bytes payload_digest record_type refers_to"}
    for short, columns in want.items():
        name = next(n for n in QUERIES if n.startswith(short + "_"))
        assert QUERIES[name](spark, SF).columns == columns.split()


def test_digest_of_text(docs, texts):
    for r in exact_dedup.mark_copies(docs).collect():
        assert r["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", texts[r["doc_id"]]).encode()).hexdigest()

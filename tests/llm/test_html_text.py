"""Main text of pages whose parts are known, and pages that are hard to read."""

import random
import time
import tracemalloc

import pytest

from timedspark.llm.html_text import Page, main_text

WORDS = "river stone letter window garden silver morning captain basket winter engine paper village bridge candle market".split()
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul>"


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 16))).capitalize() + rng.choice([", and ", "; then "]) + rng.choice(WORDS) + "."


def paragraphs(rng, n):
    return [" ".join(sentence(rng) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def html_of(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


HOLDERS = {
    "article": "<article>{}</article>", "main": "<main>{}</main>", "plain": '<div class="entry">{}</div>', "table": "<table><tr><td>{}</td></tr></table>",
    "form": '<form id="aspnetForm"><div>{}</div></form>', "form and article": "<form><article>{}</article></form>", "dialog": "<dialog open><div>{}</div></dialog>",
    "ad-free": '<div class="ad-free-content">{}</div>', "has-sidebar": '<div class="has-sidebar">{}</div>', "noscript": "<noscript><div>{}</div></noscript>"}
SIDES = ["<header><h1>Site</h1></header>", f"<nav>{MENU}</nav>", '<div class="sidebar"><p>Buy this, now, or never.</p></div>', "<footer><p>All rights reserved, 2020.</p></footer>",
         '<div class="cookie-notice"><p>We use cookies, ok?</p></div>', "<aside><p>More of it, here.</p></aside>", "<script>var x = '<p>no, no. no</p>';</script>",
         "<form><label>Mail</label><p>Subscribe now, today.</p><button>Go</button></form>", '<div class="ad-box"><p>Cheap, good, here.</p></div>']


@pytest.mark.parametrize("holder", HOLDERS)
def test_random_pages(holder):
    """Title and paragraphs come back whole and nothing else does, on pages put together at random."""
    rng = random.Random(holder)
    for _ in range(40):
        title, body = "The " + rng.choice(WORDS), paragraphs(rng, rng.randrange(4, 12))
        before, after = rng.sample(SIDES, rng.randrange(3)), rng.sample(SIDES, rng.randrange(3))
        page = f"<html><body>{''.join(before)}{HOLDERS[holder].format(f'<h1>{title}</h1>{html_of(body)}')}{''.join(after)}</body></html>"
        assert main_text(page) == "\n\n".join([title, *body]), page


RNG = random.Random(7)
TEXT, MORE = paragraphs(RNG, 5), paragraphs(RNG, 2)
ALL = "\n\n".join


@pytest.mark.parametrize(("page", "want"), [
    (f"<nav>{MENU}<div>{html_of(TEXT)}</div>", TEXT),
    (f"<nav>{MENU}<article>{html_of(TEXT)}</article>", TEXT),
    (f"<article>{html_of(TEXT)}</article><div>{html_of(MORE)}</div>", [*TEXT, *MORE]),
    (f"<article>{html_of(TEXT)}</article><div><h3>3 Comments</h3>{html_of(MORE)}</div>", TEXT),
    (f"<article>{html_of(TEXT)}</article><ul>{''.join(f'<li><p>{p}</p></li>' for p in MORE)}</ul>", TEXT),
    (f"<div class='ad-free-one'>{html_of(TEXT)}</div><div class='promo-free-two'>{html_of(TEXT)}</div>", [*TEXT, *TEXT]),
    (f"<article><h2 class='article-promotion'>How it rises</h2>{html_of(TEXT)}<div class='recommended-dose'>{html_of(MORE)}</div></article>", ["How it rises", *TEXT, *MORE]),
    (f"<article>{html_of(TEXT)}<div class='comment-list'>{html_of(MORE)}</div><div class='related-posts'><a>One</a></div></article>", TEXT),
    (f"<div>{html_of(TEXT)}</div><div class='comments'>{html_of(TEXT * 3)}</div>", TEXT),
    ("", []), ("<p>", []), ("&amp; <b>x</b>", ["& x"]), ("no tags at all", ["no tags at all"]), ("a < b, and c", ["a < b, and c"])])
def test_known_pages(page, want):
    assert main_text(page) == ALL(want)


ARTICLE = html_of(TEXT)
HARD = {"open div": "<div>" * 50_000 + ARTICLE, "unclosed links": "<a " * 66_000, "one long tag": "<a " * 66_000 + ">", "spans in blocks": "<span><p>x" * 20_000,
        "crossed": "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000 + ARTICLE, "comments": "<!-- x >" * 25_000, "sections": "<![CDATA[ x >" * 15_000 + ARTICLE,
        "quotes": "<a x='" * 30_001 + ">" + ARTICLE, "items": "<ul><li><ul>" + "<span>" * 20_000 + "</li>" * 20_000, "declarations": "<!x " * 50_000 + "<?y " * 50_000, "closed": "</p>" * 50_000 + ARTICLE}


@pytest.mark.parametrize("name", HARD)
def test_time_follows_length(name):
    started = time.process_time()
    text = main_text(HARD[name])
    assert time.process_time() - started < 4  # minutes, where every tag looks at all open ones
    if HARD[name].endswith(ARTICLE) and name not in ("quotes", "sections"):
        assert text.endswith(ALL(TEXT))


def test_memory_follows_length():
    tracemalloc.start()
    Page().read("<div>x" * 40_000)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_elements_close_like_in_browsers():
    page = Page().read("<ul><li>a<li>b<ul><li>c</ul>d</ul><p>e<p>f<table><tr><td>g<td>h</table><b>i<div>j</b>k</div>l")
    paths = []
    for e, text in zip(page.elements, page.texts):
        chain = []
        while e:
            chain.append(page.tags[e])
            e = page.parents[e]
        paths.append(("/".join(reversed(chain)), text))
    assert paths == [("ul/li", "a"), ("ul/li", "b"), ("ul/li/ul/li", "c"), ("ul/li", "d"), ("p", "e"), ("p", "f"), ("table/tr/td", "g"), ("table/tr/td", "h"),
                     ("b", "i"), ("b/div", "j"), ("b/div", "k"), ("b", "l")]

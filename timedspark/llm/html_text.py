"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements that make blocks, elements that never hold main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"audio", "button", "canvas", "datalist", "embed", "head", "iframe", "input", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video"}
#: Elements that hold side parts, unless the page's text turns out to be in them; `header` too, outside an article.
SELDOM = {"aside", "dialog", "footer", "form", "header", "menu", "nav", "noscript", "search"}
#: What an element's class, id or role says of it, as a whole token or a part of one.
SIDE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
           "signup login sidebar widget widgets related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer masthead "
           "comment comments commentlist respond replies reply disqus discussion copyright legal disclaimer search complementary contentinfo skip".split())
#: Words of SIDE that also occur in names of parts of an article, as in `recommended-dose`; inside an article they count only as whole tokens or where the path scores agree.
WEAK = set("ad ads alert banner complementary copyright disclaimer discussion legal login masthead modal notice notices overlay popup promo promotion recommendations recommended related search share sharing skip "
           "social sponsor sponsored subscription toc widget".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl", "details"}
#: Headings of reader comments.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|latest|all)\s+)?(?:comments?|responses?|replies|discussion|leave a|join the|kommentare|commentaires|comentarios)\b", re.IGNORECASE)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select", "article", "section", "div", "main"}
#: Parts of an article, never the whole.
INLINE = {"p", "li", "td", "b", "i", "em", "strong", "span", "a", "blockquote", "pre", "h1", "h2", "h3"}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
WORDS = re.compile(r"[a-z]+")
COMMENT_END, SECTION_END = re.compile(r"--!?\s*>"), re.compile(r"\]\]>")
MARKED = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata)\s*\[", re.IGNORECASE)
#: Words in a class token that say of a wrapper what it has beside the text, as in `has-sidebar`.
ABOUT = {"has", "have", "having", "no", "not", "with", "without", "hide", "show"}


class Page(HTMLParser):
    """Elements of a page, numbered in order, and its text nodes. Element 0 is the page itself.

    An element has its tag, its parent, and the number of its tag path; a text node has its element, its block and its
    text. So a page takes memory in proportion to its length, however deep its elements lie.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.paths = [""], [-1], [0]
        self.never, self.doubts = [False], {}
        self.path_numbers: dict[tuple[int, str], int] = {}
        self.open = [0]
        #: Places in `open` of each tag.
        self.places: dict[str, list[int]] = {}
        self.elements: list[int] = []
        self.blocks: list[int] = []
        self.texts: list[str] = []
        self.block = 0
        #: From here on nothing ends a comment or a marked section.
        self.endless = {COMMENT_END: 1 << 62, SECTION_END: 1 << 62}

    def read(self, html: str) -> Page:
        """Take in the page. What follows the last `>` holds no whole tag and is text."""
        last = html.rfind(">") + 1
        self.feed(html[:last])
        self.close()
        if html[last:]:
            self.text(unescape(html[last:]))
        return self

    def doubt(self, tag: str, attributes: list[tuple[str, str | None]]) -> str | None:
        """What speaks against the element: its tag, a whole token of class, id or role, or a part of one (`weak` if the part is a word of WEAK)."""
        if tag in SELDOM and not (tag == "header" and (self.places.get("article") or self.places.get("main"))):
            return "tag"
        found = None
        for name, value in attributes:
            if name in ("class", "id", "role"):
                for token in (value or "").lower().split():
                    if token in SIDE:
                        return "whole"
                    words = set(WORDS.findall(token))
                    if SIDE & words and not ABOUT & words:
                        found = "part" if found == "part" or SIDE & words - WEAK else "weak"
        return found

    def is_hidden(self, tag: str, attributes: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower()
                   for name, value in attributes)

    def pop(self, place: int) -> None:
        """Close the element at a place of `open` and all inside it."""
        while len(self.open) > place:
            self.places[self.tags[self.open.pop()]].pop()

    def leave(self, tag: str, stops: set[str]) -> None:
        """Close the innermost `tag` and what is open inside it, unless an element of `stops` is nearer."""
        places = self.places.get(tag)
        if places and not any(self.places.get(s) and self.places[s][-1] > places[-1] for s in stops):
            self.pop(places[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.block += 1
            self.leave("p", HOLDERS | {"td", "th"})
        for other in CLOSES.get(tag, ()):
            self.leave(other, {"ul", "ol", "menu", "dl", "table", "select"})
        if tag == "br":
            self.text("\n")
        if tag in VOID:
            return
        parent, number = self.open[-1], len(self.tags)
        if tag not in ("html", "body") and (why := self.doubt(tag, attrs)):
            self.doubts[number] = why
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(number)
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(self.path_numbers.setdefault((self.paths[parent], tag), len(self.path_numbers) + 1))
        self.never.append(self.is_hidden(tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        self.leave(tag, set() if tag in BLOCKS else BLOCKS)

    def ends(self, mark: re.Pattern[str], i: int) -> bool:
        """Whether `mark` comes after `i`; where it did not once, the rest is not searched again."""
        if i < self.endless[mark] and not mark.search(self.rawdata, i):
            self.endless[mark] = i
        return i < self.endless[mark]

    def parse_comment(self, i: int, report: int = 1) -> int:
        return super().parse_comment(i, report) if self.ends(COMMENT_END, i + 4) else -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Only CDATA and its like end at ]]>; any other <![ is a bogus comment up to the next >, as in browsers."""
        if MARKED.match(self.rawdata, i) and self.ends(SECTION_END, i):
            return super().parse_marked_section(i, report)
        return self.rawdata.find(">", i) + 1 or -1

    def handle_data(self, data: str) -> None:
        self.text(data)

    def text(self, data: str) -> None:
        if data:
            self.elements.append(self.open[-1])
            self.blocks.append(self.block)
            self.texts.append(data)

    def below(self, marked: set[int] | list[bool]) -> list[bool]:
        """For every element, whether it or one that holds it is marked."""
        if isinstance(marked, list):
            out = [marked[0]]
            for own, parent in zip(marked[1:], self.parents[1:]):
                out.append(own or out[parent])
        else:
            out = [0 in marked]
            for e, parent in enumerate(self.parents[1:], 1):
                out.append(out[parent] or e in marked)
        return out

    def held(self, sizes: dict[int, int]) -> list[int]:
        """For every element, the sum of `sizes` (by element) in it."""
        sums = [sizes.get(e, 0) for e in range(len(self.tags))]
        for e in range(len(self.tags) - 1, 0, -1):
            sums[self.parents[e]] += sums[e]
        return sums


def path_scores(page: Page, aside: list[bool], radius: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text node: text length and punctuation per node of its tag path, smoothed along the page, multiplied; and both, a row each, without smoothing."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    paths, shown = [page.paths[e] for e in page.elements], []
    for path, e, text in zip(paths, page.elements, page.texts):
        bare = len(" ".join(text.split()))
        shown.append(bool(bare) and not aside[e])
        if shown[-1]:
            length[path] += bare
            marks[path] += len(PUNCTUATION.findall(text))
            count[path] += 1
    by_length = np.array([length[p] / max(count[p], 1) for p in paths])
    by_marks = np.array([marks[p] / max(count[p], 1) for p in paths])
    kernel = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, radius, mode="edge"), kernel, mode="valid")
    return np.where(shown, smooth(by_length) * smooth(by_marks), 0.0), np.stack([by_length, by_marks])


def chosen_nodes(page: Page, aside: list[bool]) -> tuple[list[int], np.ndarray]:
    """Text nodes whose fused path score exceeds the standard deviation of all scores, and both ratios of all nodes."""
    scores, own = path_scores(page, aside)
    return np.flatnonzero(scores > min(scores.std(), scores.max() * 0.999)).tolist(), own


def side_elements(page: Page, aside: list[bool]) -> set[int]:
    """Elements in doubt that do not hold the page's text.

    Where an article or main element lies outside all of them, the text is there; inside it a heading, and an element doubted for a weak part
    of its name that holds text of the path scores' choice, stay. Otherwise elements stay that hold an article with most of the chosen text; else
    those with most of the chosen text by their own: all of it where a whole token speaks against them, nine tenths where the tag does, more than half where a part does, a third where that is weak.
    If only parts of names speak against all of the text, those with the most of it stay.
    """
    doubts = page.doubts
    if not doubts:
        return set()
    sizes: dict[int, int] = defaultdict(int)
    for k in chosen_nodes(page, aside)[0]:
        sizes[page.elements[k]] += len(page.texts[k])
    holds = page.held(sizes)
    total = holds[0]
    articles = {e for e, tag in enumerate(page.tags) if tag in ("article", "main") and e not in doubts and not aside[e]}
    doubted = page.below(set(doubts))
    if free := {e for e in articles if not doubted[e]}:
        inside = page.below(free)
        stay = {e for e, why in doubts.items() if inside[e] and (page.tags[e] in HEADINGS and why in ("weak", "part") or why == "weak" and holds[e])}
        return set(doubts) - stay
    kept = {e for e in articles if 2 * holds[e] > total}
    stay = set()
    for e in kept:
        while e > 0:
            if e in doubts:
                stay.add(e)
            e = page.parents[e]
    if not stay and total:
        least = {"whole": total, "tag": 0.9 * total, "part": total / 2 + 0.5, "weak": total / 3}
        stay = {e for e, why in doubts.items() if holds[e] >= least[why]}
    if not stay and total:
        left = page.below({e for e, why in doubts.items() if why in ("whole", "tag")})
        rest = page.held({e: n for e, n in sizes.items() if not left[e]})
        parts = {e: rest[e] for e, why in doubts.items() if why in ("part", "weak") and rest[e]}
        if parts and sum(n for e, n in sizes.items() if not doubted[e]) < max(parts.values()) / 2:
            stay = {e for e, n in parts.items() if 2 * n >= max(parts.values())}
    return set(doubts) - stay


def main_text(html: str | None) -> str:
    """Text of the page's article: blocks in page order, two line ends between them.

    Text nodes whose fused path score exceeds the standard deviation of all scores are content. The smallest element that holds all of
    them is the article, with all of its blocks that are not set aside by their element or its name. What comes after the last article or main element with
    content belongs to it where the path scores choose it and its own path has half the article's length and punctuation, outside lists and up to a heading of reader comments. Where no node passes, an
    article or main element is taken, else the whole page. Time and memory follow the length of the page, however many elements are open at once.
    """
    page = Page().read(html or "")
    if not page.texts:
        return ""
    aside = page.below(page.never)
    side = side_elements(page, aside)
    aside = page.below([never or e in side for e, never in enumerate(page.never)])
    chosen, own = chosen_nodes(page, aside)
    articles = {e for e, tag in enumerate(page.tags) if tag in ("article", "main")}
    in_article = page.below(articles)
    root, end, late = min(articles, default=None), len(page.texts), set()
    if chosen:
        within = [k for k in chosen if in_article[page.elements[k]]]
        if within and 2 * sum(len(page.texts[k]) for k in within) > sum(len(page.texts[k]) for k in chosen):
            holding = page.held({page.elements[k]: 1 for k in within})
            marked = page.below({e for e in articles if holding[e]})
            end = 1 + max(k for k, e in enumerate(page.elements) if marked[e])
            if chosen[-1] >= end:
                listed = page.below({e for e, tag in enumerate(page.tags) if tag in LISTS})
                heads = page.below({e for e, tag in enumerate(page.tags) if tag in HEADINGS})
                stop = next((k for k in range(end, len(page.texts)) if heads[page.elements[k]] and COMMENTS.match(page.texts[k])), len(page.texts))
                alike = own[:, within].mean(axis=1) / 2
                chosen = [k for k in chosen if k < end or k < stop and (own[:, k] >= alike).all() and not listed[page.elements[k]]]
                late = {page.blocks[k] for k in chosen if k >= end}
        counts: dict[int, int] = defaultdict(int)
        for k in chosen:
            counts[page.elements[k]] += 1
        holding = page.held(counts)
        root = max((e for e in range(len(page.tags)) if holding[e] == len(chosen) and page.tags[e] not in INLINE), default=None)
    inside = page.below({0 if root is None else root})
    blocks: dict[int, list[str]] = {}
    for k, (e, block) in enumerate(zip(page.elements, page.blocks)):
        if not aside[e] and inside[e] and (k < end or block in late):
            blocks.setdefault(block, []).append(page.texts[k])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty html, and pages without text outside menus and the like, give an empty text. Character references are decoded. Rows that repeat
    are read alike; an empty table gives an empty result; columns other than page_id, url and html are not read.
    """
    given = pages.select("page_id", "url", "html")
    kind = given.schema["page_id"].dataType.simpleString()
    return given.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")

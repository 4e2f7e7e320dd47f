"""Licence scans: Aho-Corasick over words, expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedspark.llm.common import word_bytes

#: The phrases every scan counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of the method's own, and their labels.
NOTICES = {
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "2 clause bsd license": "bsd-2-clause", "3 clause bsd license": "bsd-3-clause",
    "isc license": "isc", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
    "creative commons attribution": "cc-by", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAGGED = re.compile(rb"spdx[-_ ]license[-_ ]identifier\s*:?\s*([^\r\n]*)", re.IGNORECASE)
SYMBOL = re.compile(rb"[()]|(?:[Dd]ocument[Rr]ef-[A-Za-z0-9.-]+:)?[A-Za-z0-9][A-Za-z0-9.+-]*")
#: Identifiers of the public licence list that are whole as they stand, and families that a version follows.
PLAIN_IDS = (
    "0bsd", "beerware", "blessing", "bsd-1-clause", "bsd-2-clause", "bsd-2-clause-patent", "bsd-2-clause-views", "bsd-3-clause", "bsd-3-clause-clear",
    "bsd-3-clause-lbnl", "bsd-4-clause", "bsd-4-clause-uc", "bsd-source-code", "cc-pddc", "curl", "fair", "ftl", "hpnd", "icu", "ijg", "imagemagick", "info-zip",
    "intel", "isc", "json", "libpng", "libtiff", "mit", "mit-0", "mit-cmu", "mit-feh", "mit-modern-variant", "ms-lpl", "ms-pl", "ms-rl", "ncsa", "ntp",
    "openssl", "postgresql", "ruby", "sax-pd", "sissl", "sleepycat", "tcl", "unicode-tou", "unlicense", "vim", "w3c", "wtfpl", "x11", "xnet", "zlib", "zlib-acknowledgement",
)
VERSIONED_IDS = (
    "afl", "agpl", "apache", "apsl", "artistic", "blueoak", "bsl", "busl", "bzip2", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0",
    "cddl", "cecill", "cpal", "cpl", "ecl", "efl", "elastic", "epl", "eudatagrid", "eupl", "gfdl", "gpl", "hippocratic", "ipl", "lgpl", "libpng", "lppl", "mpl",
    "mulanpsl", "nasa", "ncl", "nposl", "odbl", "odc-by", "ofl", "ogl-uk", "oldap", "osl", "pddl", "php", "polyform-noncommercial", "polyform-small-business", "psf",
    "python", "qpl", "rpl", "rpsl", "spl", "sspl", "unicode-dfs", "upl", "vsl", "w3c", "xfree86", "zpl",
)
IDENTIFIER = re.compile("(?:" + "|".join(PLAIN_IDS) + r")\+?|(?:" + "|".join(VERSIONED_IDS) + r")-v?[0-9][a-z0-9.]*(?:-[a-z0-9.]+)*\+?"
                        r"|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|additionref-[a-z0-9.-]+|llgpl")
BINDING = {"or": 1, "and": 2, "with": 3}
#: How sure a label is by where it was found; several finds add up as chances do.
SURE = {"tag": 0.95, "base": 0.9, "notice": 0.6}

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase), label, "notice"))
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", (len(phrase), label, "base"))
    found.add_word(f" {TAG} ", (len(TAG), "", "tag"))
    found.make_automaton()
    return found


def identifier_label(name: str) -> str:
    """Label of a licence identifier: lower case, without `-only`, `-or-later`, `+` and a trailing `.0`; named base licences as they are named there."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    name = re.sub(r"\.0$", "", name)
    return re.sub(r"^(cc-by[a-z-]*)-\d.*$", r"\1", name)


def is_identifier(name: str, exception: bool) -> bool:
    """Whether a lower-case name is one of a licence, or of an exception after `with`; other words are prose."""
    return bool((EXCEPTION if exception else IDENTIFIER).fullmatch(name))


def expression_symbols(expression: bytes, accepts: Callable[[str, bool], bool]) -> list[str]:
    """Lower-case symbols of the longest valid beginning of a licence expression; none if no beginning is valid.

    `with` stands between one name of a licence and one of an exception, so it cannot follow a bracket or another
    exception. `accepts(name, exception)` says which names there are; the first that is not accepted ends it.
    """
    symbols: list[str] = []
    whole = depth = 0
    operand, named = True, False
    for match in SYMBOL.finditer(expression):
        word = match[0].decode().lower().rstrip(".")
        exception = operand and symbols[-1:] == ["with"]
        if operand and word == "(" and not exception:
            depth += 1
        elif operand and word not in BINDING and word not in ("(", ")") and accepts(word, exception):
            operand, named = False, not exception
        elif not operand and word == ")" and depth:
            depth, named = depth - 1, False
        elif not operand and word in BINDING and (named or word != "with"):
            operand = True
        else:
            break
        symbols.append(word)
        if not operand and not depth:
            whole = len(symbols)
    return symbols[:whole]


def expression_labels(expression: bytes, accepts: Callable[[str, bool], bool] = lambda name, exception: True) -> set[str] | None:
    """Labels of a licence expression such as `(MIT OR Apache-2.0) AND GPL-2.0 WITH x`, or None if it is none.

    Operators bind as with, and, or. `a or b` and `a and b` have the labels of both sides, `a with b` is one
    label. What follows the longest valid beginning is not read. Symbols are read once and the smaller set joins
    the larger one, so that time and memory follow the length of the line.
    """
    output: list[set[str]] = []
    waiting: list[str] = []

    def reduce() -> None:
        right, left = output.pop(), output.pop()
        if waiting.pop() == "with":
            left = {f"{left.pop()} with {right.pop()}"}
        else:
            left, right = (left, right) if len(left) >= len(right) else (right, left)
            left |= right
        output.append(left)

    for word in expression_symbols(expression, accepts):
        if word == "(":
            waiting.append(word)
        elif word == ")":
            while waiting[-1] != "(":
                reduce()
            waiting.pop()
        elif word in BINDING:
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[word]:
                reduce()
            waiting.append(word)
        else:
            output.append({identifier_label(word)})
    while waiting:
        reduce()
    return output[0] if output else None


def scan_text(text: str | None, finder: ahocorasick.Automaton) -> tuple:
    words = word_bytes(text)
    joined = f" {b' '.join(words).decode('latin-1')} "
    base: list[int] = []
    labels: dict[str, str] = {}
    base_labels: set[str] = set()
    at = counted = 0
    tagged = False
    for end, (length, label, how) in finder.iter(joined):
        if how == "tag":
            tagged = True
            continue
        start = end - length - 1
        if how == "base":
            # Blanks up to a word are the words before it. Ends rise, so the count goes on from the last place; starts may step back.
            counted += joined.count(" ", at, start + 1) if start + 1 >= at else -joined.count(" ", start + 1, at)
            at = start + 1
            base.append(counted - 1)
            base_labels.add(label)
        if labels.get(label) != "base":
            labels[label] = how
    if tagged:
        for match in TAGGED.finditer(text.encode()):
            for label in expression_labels(match[1], is_identifier) or ():
                labels[label] = "tag"
    unsure = 1.0
    for how in labels.values():
        unsure *= 1 - SURE[how]
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(1 - unsure, 6))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = automaton()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        rows = [scan_text(t.as_py(), finder) for t in batch.column("text")]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])


def scan_licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document.

    A-Z is lower-cased and the words joined by blanks; one automaton finds the phrases of BASE and NOTICES and the
    identifier tag in it. After a tag the rest of the line is read as a licence expression of known identifiers;
    a line that begins with another word has none. `score` is the chance that at least one label is right, from
    SURE. Null and wordless texts have zeros, nulls for places and empty labels. A very long text is one value of
    its task, held a few times over; time follows its length, also that of its expressions. Labels found twice
    count once, by their surest find. Rows that repeat are scanned alike; an empty table gives an empty result;
    other columns, whatever their names, are not read.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(_scan, f"doc_id {kind}, {RESULT}")

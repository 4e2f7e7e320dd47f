"""Text rules: titles, slugs, scripts, sentences, links, times and similarity."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

TITLE_MAX_CHARS = 38
TITLE_MIN_WORDS, TITLE_MAX_WORDS = 3, 7


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_title(title: Column) -> Column:
    """Single spaces, no trailing punctuation."""
    return F.rtrim(collapse_spaces(title), F.lit(" .,!?;:"))


def word_count(text: Column) -> Column:
    squeezed = collapse_spaces(text)
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))


def latin_only(text: Column) -> Column:
    """Every letter belongs to the Latin script."""
    return ~text.rlike(r"(?=\p{L})\P{IsLatin}")


def has_letters(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def title_fits(title: Column, latin: bool = False) -> Column:
    """3 to 7 words and at most 38 characters, in Latin letters if asked for."""
    fits = word_count(title).between(TITLE_MIN_WORDS, TITLE_MAX_WORDS) & (F.char_length(title) <= TITLE_MAX_CHARS)
    return fits & latin_only(title) if latin else fits


def slug(text: Column, max_chars: int = 40) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", ""))
    cut = F.left(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), F.lit(max_chars))
    return F.when(cut == "", F.lit("clip")).otherwise(cut)


def romanise_danda(text: Column, caption_is_latin: Column) -> Column:
    """Danda signs become full stops when the caption, or this word alone, is in Latin letters.

    `caption_is_latin`: all letters of the caption are Latin and there is one.
    """
    applies = caption_is_latin | (has_letters(text) & latin_only(text))
    return F.when(applies, F.translate(text, "।॥", "..")).otherwise(text)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, or the first 80 characters."""
    head = F.concat(F.trim(F.split_part(text, F.lit("."), F.lit(1))), F.lit("."))
    return F.when(F.contains(text, F.lit(".")), head).otherwise(F.left(text, F.lit(80)))


def last_sentence(text: Column) -> Column:
    """The part before the last full stop after the one before it, or the last 80 characters."""
    parts = F.split(text, r"\.")
    tail = F.concat(F.trim(F.element_at(parts, -2)), F.lit("."))
    return F.when(F.size(parts) >= 3, tail).otherwise(F.right(text, F.lit(80)))


def quotes_excerpt(quote: Column, excerpt: Column) -> Column:
    """The quote, spaces collapsed, is part of the excerpt."""
    return F.coalesce(F.trim(quote) != "", F.lit(False)) & F.contains(collapse_spaces(excerpt), collapse_spaces(quote))


def clock(ms: Column) -> Column:
    """mm:ss, seconds rounded down."""
    return F.format_string("%02d:%02d", F.floor(ms / 60_000), F.floor(ms / 1_000) % 60)


def clock_hundredths(ms: Column) -> Column:
    """mm:ss.hh"""
    return F.format_string("%02d:%02d.%02d", F.floor(ms / 60_000), F.floor(ms / 1_000) % 60, F.floor(ms % 1_000 / 10))


def segment_line(start_ms: Column, end_ms: Column, text: Column, seconds: bool = True) -> Column:
    """`[mm:ss-mm:ss] text`, or seconds with two decimals."""
    show = clock if seconds else lambda ms: F.format_string("%.2f", ms / 1_000)
    return F.concat(F.lit("["), show(start_ms), F.lit("-"), show(end_ms), F.lit("] "), F.trim(text))


# Fixed hosts and path forms of accepted video links.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com")
SHORT_HOST = "youtu.be"


def video_id(url: Column, hosts: tuple[str, ...] = VIDEO_HOSTS, short_host: str = SHORT_HOST,
             id_pattern: str = "[A-Za-z0-9_-]{11}") -> Column:
    """Identifier of a single-video https link, or null."""
    u = F.trim(url)
    parts = r"^https://([^/?#@:]+)(?::443)?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
    host = F.lower(F.regexp_extract(u, parts, 1))
    path = F.regexp_extract(u, parts, 2)
    asked = F.regexp_extract(F.regexp_extract(u, parts, 3), r"(?:^|&)v=([^&]*)", 1)
    direct = F.regexp_extract(path, rf"^/(?:live|shorts|embed)/({id_pattern})/?$", 1)
    found = (F.when(host == short_host, F.btrim(path, F.lit("/")))
             .when(host.isin(*hosts) & (path == "/watch"), asked)
             .when(host.isin(*hosts), direct))
    return F.when(found.rlike(f"^{id_pattern}$"), found)


def clean_tags(tags: Column, limit: int = 15) -> Column:
    """Letters, digits and underscores only, `#` in front, first spelling of each, at most `limit`."""
    cleaned = F.filter(F.transform(tags, lambda t: F.concat(F.lit("#"), F.regexp_replace(t, r"[^A-Za-z0-9_]", ""))),
                       lambda t: F.char_length(t) > 1)

    # Distinct spellings are found by hash; the first place of each of the few that stay gives its spelling.
    return F.get(F.transform(F.array(cleaned), lambda all_tags: F.get(F.transform(F.array(F.transform(all_tags, F.lower)), lambda low: F.transform(
        F.slice(F.array_distinct(low), 1, limit), lambda k: F.get(all_tags, (F.array_position(low, k) - 1).cast("int")))), F.lit(0))), F.lit(0))


def caption_with_tags(caption: Column, tags: Column, limit: int = 2_200) -> Column:
    joined = F.array_join(tags, " ")
    full = F.when(joined != "", F.concat(F.trim(caption), F.lit("\n\n"), joined)).otherwise(F.trim(caption))
    return F.left(full, F.lit(limit))


@lru_cache(maxsize=65_536)
def _bare(value: str | None) -> str | None:
    if value is None:
        return None
    plain = value.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return " ".join(token if token.isalnum() else "".join(filter(str.isalnum, token)) for token in plain.split()).strip()


@F.pandas_udf(StringType())
def skeleton(text: pd.Series) -> pd.Series:
    """Lower case without combining marks and punctuation, one space between tokens. Words come again and again, so what they gave is kept."""
    return text.map(_bare)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio in [0, 1]."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def similarity_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """At least the matching-block ratio: twice the letters in common, wherever they stand, over all letters."""
    letters: dict[str, list[tuple[str, int]]] = {}

    def bound(x, y):
        if x is None or y is None:
            return None
        counts = letters.get(y)
        if counts is None:
            counts = letters[y] = list(Counter(y).items())
        common = sum(min(n, x.count(c)) for c, n in counts)
        return 2.0 * common / (len(x) + len(y)) if x or y else 1.0
    return pd.Series([bound(x, y) for x, y in zip(a, b)], dtype="float64")


def token_digest(value: Column) -> Column:
    return F.sha2(value, 256)


def fingerprint(inputs: Column) -> Column:
    """Digest of a struct of inputs in one canonical JSON form (declare its fields in name order)."""
    return F.sha2(F.to_json(inputs), 256)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")

"""JSON found inside model replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


FENCE = "```"
#: Fixed value: the first flat object of a reply in prose, as replies are read.
FLAT_OBJECT = r"(?s)\{[^{}]+\}"


def fenced(raw: Column) -> Column:
    """Content of the first code fence, or the whole trimmed text."""
    opened = F.instr(raw, FENCE)
    after = F.substr(raw, opened + len(FENCE))
    after = F.when(after.startswith("json"), F.substr(after, F.lit(5))).otherwise(after)
    closed = F.instr(after, FENCE)
    inner = F.trim(F.regexp_replace(F.left(after, closed - 1), r"^\s+|\s+$", ""))
    return F.when((opened > 0) & (closed > 0) & (inner != ""), inner).otherwise(F.trim(raw))


def outer_object(raw: Column) -> Column:
    """From the first `{` to the last `}` of the fenced text, or null."""
    text = fenced(raw)
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def flat_object(raw: Column) -> Column:
    """The text itself when it is one object, else the first `{...}` without braces inside.

    The second case returns an inner object of a nested reply in prose.
    """
    whole = F.trim(raw)
    inner = F.regexp_extract(raw, FLAT_OBJECT, 0)
    return F.when(whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole).when(inner != "", inner)


def lenient_array(raw: Column) -> Column:
    """The text itself when it is one array, else the first `[{...}]` up to the nearest close."""
    whole = F.trim(raw)
    inner = F.regexp_extract(raw, r"(?s)\[\s*\{.*?\}\s*\]", 0)
    return F.when(whole.startswith("[") & F.try_parse_json(whole).isNotNull(), whole).when(inner != "", inner)


@F.pandas_udf(StringType())
def _leading_array(text: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def decode(value):
        at = -1 if value is None else value.find("[")
        if at < 0:
            return None
        try:
            return json.dumps(decoder.raw_decode(value[at:])[0], ensure_ascii=False)
        except ValueError:
            return None
    return text.map(decode)


def leading_array(raw: Column) -> Column:
    """First JSON array of the fenced text, whatever follows it; null when it does not decode.

    Text that ends with the array stays in the JVM; only the rest goes to Python.
    """
    text = fenced(raw)
    tail = F.regexp_extract(text, r"(?s)\[.*\]\s*$", 0)
    simple = (tail != "") & F.try_parse_json(tail).isNotNull()
    return F.when(simple, tail).otherwise(_leading_array(F.when(~simple, text)))

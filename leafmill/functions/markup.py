"""Text of XML and HTML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import lines_normalised

#: Fixed values, in this order: the ampersand goes first, so `&amp;lt;` ends as `<`.
NAMED = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def named_entities(text: Column) -> Column:
    for name, sign in NAMED:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


@F.pandas_udf(T.StringType())
def _numbered(text: pd.Series) -> pd.Series:
    def sign(n: int) -> str:
        return chr(n & 0xFFFF) if not 0xD800 <= n & 0xFFFF < 0xE000 else "�"

    def run(t: str) -> str:
        t = re.sub(r"&#(\d+);", lambda m: sign(int(m[1])), t)
        return re.sub(r"&#x([a-fA-F0-9]+);", lambda m: sign(int(m[1], 16)), t)

    return text.map(run, na_action="ignore")


def entities(text: Column) -> Column:
    """Named entities stay in the JVM; only texts with numbered ones go through Python."""
    named = named_entities(text)
    return F.when(named.rlike(r"&#[0-9xX]"), _numbered(named)).otherwise(named)


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def markup_text(text: Column) -> Column:
    return lines_normalised(entities(without_tags(text)))

"""Cleaning of extracted text, line by line."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, lines_normalised, trimmed

#: White space within a line of a compatible() text, which has no other.
INLINE = r"[ \t\x{0b}\x{0c}\r\x{1680}\x{2028}\x{2029}\x{feff}]"
#: Those of it beyond ASCII.
RARE = "\u1680\u2028\u2029\ufeff"
#: Signs beyond ASCII that NFKC leaves as they are, and joins with no other one of these: most of Latin-1, accented Latin
#: letters, quotes and dashes.
STABLE = r"[\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{2013}\x{2014}\x{2018}\x{2019}\x{201c}\x{201d}]"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """NFKC; texts of nothing but signs that stay as they are never leave the JVM."""
    return F.coalesce(_nfkc(F.when(beyond_ascii(text) & text.rlike(rf"[^\x00-\x7f](?<!{STABLE})"), text)), text)


def beyond_ascii(text: Column) -> Column:
    """Told without a look at each sign."""
    return F.octet_length(text) != F.length(text)


def spaces_normalised(text: Column) -> Column:
    """Straight quotes, plain dashes, single blanks, no blank before closing signs or after opening ones; line by line, of
    a whole compatible() text at once. Patterns that few texts need are left out for the others by plain looks at the text,
    which has rare blanks or doubled ones only where it had them before each step."""
    rare, doubled = (reduce(or_, (F.contains(text, F.lit(s)) for s in signs)) for signs in (RARE, ("  ", "\t")))
    x = F.when(beyond_ascii(text) & text.rlike("[–-”]"), F.translate(text, "“”‘’–—", "\"\"''--")).otherwise(text)
    closed = lambda blank: F.regexp_replace(x, rf"{blank}+(?=[,.;:!?)\]}}])|([(\[{{]){blank}+", "$1")
    x = F.when(rare, closed(INLINE)).otherwise(closed(r"[ \t\x{0b}\x{0c}\r]"))
    return F.when(doubled, F.regexp_replace(x, r"[ \t]{2,}+", " ")).otherwise(x)


def only_signs(line: Column) -> Column:
    """At least three signs, and no letter or digit among them."""
    return ~line.rlike(r"[A-Za-z0-9\p{L}\p{N}]") & (F.length(F.regexp_replace(line, f"{SPACE}+", "")) >= 3)


def kept_lines(text: Column) -> Column:
    """Lines of a spaces_normalised() text, without blanks at their ends, that aren't empty or signs only."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~only_signs(x))


def firsts(lines: Column) -> Column:
    """Lines of which no earlier one is the same in lower case, in their order: sorted by form and place, each line is
    compared with the one before it, and the rest goes back by place. Nothing is sorted where no line comes again."""
    marked = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("line"))))
    own = F.zip_with(marked, F.concat(F.array(F.lit(None).cast("string")), F.transform(marked, lambda m: m["low"])), lambda m, before: F.when(
        m.isNotNull() & ~m["low"].eqNullSafe(before), F.struct(m["at"].alias("at"), m["line"].alias("line"))))
    some = F.transform(F.array_sort(F.array_compact(own)), lambda m: m["line"])
    return F.when(F.size(F.array_distinct(F.transform(lines, F.lower))) == F.size(lines), lines).otherwise(some)


def cleaned(docs: DataFrame, text: str = "text", to: str = "clean_lines") -> DataFrame:
    """docs with the array of clean lines, each (by lower case) at its first place; joined by line feeds they are the
    clean text. Each step is a column that the next uses, so none is worked out again for every line."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), compatible(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r"), F.lit("\n"))).alias("own"))
    step = own.select("row", kept_lines(spaces_normalised(F.col("own"))).alias("lines")).select("row", firsts(F.col("lines")).alias("lines"))
    return step.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != to), F.col("lines").alias(to))


def merged_lines(chunks: Column) -> Column:
    """One text from several readings of a page: lines with single blanks, each (by lower case) at its first place."""
    lines = F.flatten(F.transform(chunks, lambda c: F.split(lines_normalised(F.coalesce(c, F.lit(""))), "\n")))
    single = F.transform(lines, lambda x: trimmed(F.regexp_replace(x, f"{SPACE}+", " ")))
    return F.array_join(firsts(F.filter(single, lambda x: x != "")), "\n")

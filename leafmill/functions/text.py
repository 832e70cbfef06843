"""Plain text: white space, case, and the two ways in which searching and organising simplify a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as white space, which Java's \s takes for ASCII only.
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: Blanks of any width: Unicode's space separators, without tabs and line ends.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: The same signs one by one.
SPACES = "\t\n\x0b\x0c\r\u2028\u2029\ufeff" + BLANKS


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def lines_normalised(text: Column) -> Column:
    """One kind of line end, no blanks at line ends, at most one empty line in a row."""
    one = F.replace(text, F.lit("\r"), F.lit("\n"))
    ends = F.regexp_replace(one, r"[ \t]+\n", "\n")
    return trimmed(F.regexp_replace(ends, r"\n{3,}", "\n\n"))


def spaces_collapsed(text: Column) -> Column:
    """As lines_normalised, and runs of blanks and tabs are one blank."""
    return trimmed(F.regexp_replace(lines_normalised(text), r"[ \t]{2,}", " "))


def search_text(text: Column) -> Column:
    """Lower case; whatever isn't a-z or a digit becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def compact_text(text: Column) -> Column:
    """As search_text, without blanks."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def rule_text(text: Column) -> Column:
    """Lower case; signs that join words become blanks; a-z, digits, dots and angle brackets stay."""
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[#/\\_-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9.<>\s]+", " "), r"\s+", " "))

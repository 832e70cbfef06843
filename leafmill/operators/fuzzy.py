"""Words that are nearly the same, compared once for each different word.

How many edits a word may be off depends on the length of the word that is asked for, and its length may differ by one.
A kept dictionary has two ways to candidates. Words of one edit share a form that each becomes by leaving out no letter
or one: a join on forms, which are kept for words of up to LONG letters. For more edits, which only recognised text
allows, and for longer words, all words of fitting length are compared; they lie sorted by length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words below this length have no near ones; words above it have no forms.
LEAST, LONG = 4, 64


def allowed(token: str, recognised: bool) -> int:
    """Edits that a word may be off; 0 if it has no near words."""
    n = len(token)
    if n < LEAST or token.isdigit():
        return 0
    return (3 if n >= 7 else 2 if n == 6 else 1) if recognised else 1


def fits(word: Column, token: str, recognised: bool) -> Column:
    """Whether a word is nearly the token."""
    edits = allowed(token, recognised)
    if not edits:
        return F.lit(False)
    return (F.abs(F.length(word) - len(token)) <= 1) & (F.levenshtein(word, F.lit(token), edits) >= 0)


def forms(word: Column) -> Column:
    """A word and what it becomes without one of its letters; nothing for words too short or too long."""
    n = F.length(word)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when((n >= LEAST - 1) & (n <= LONG), F.array_distinct(F.concat(F.array(word), without))).otherwise(F.array().cast("array<string>"))


def own_forms(token: str) -> list[str]:
    """forms() of a word, on the driver."""
    return sorted({token, *(token[:i] + token[i + 1:] for i in range(len(token)))})


def by_forms(token: str, recognised: bool) -> bool:
    """Whether the near words of a token are all found by its forms."""
    return allowed(token, recognised) == 1 and len(token) < LONG


def close(words: DataFrame, forms: DataFrame, token: str, recognised: bool = False) -> DataFrame:
    """token: the different words of a dictionary that are nearly `token`, itself too: from words (token, n) and forms
    (form, token)."""
    if by_forms(token, recognised):
        rows = forms.filter(F.col("form").isin(own_forms(token)))
    else:
        rows = words.filter(F.col("n").between(len(token) - 1, len(token) + 1))
    return rows.select("token").distinct().filter(fits(F.col("token"), token, recognised))


def among(rows: DataFrame, texts: list[str], cut, asked: list[tuple[str, bool]], most: int) -> dict[tuple[str, bool], list[str]] | None:
    """Of the words of the columns `texts`, those near to each of `asked` (token, recognised). What lies between blanks is
    collected first, and only different ones are cut into words by cut(column), which leaves those without digits whole or out, and compared. None if there are more near
    words than `most`; then they should stay where they are."""
    asked = [a for a in asked if allowed(*a)]
    if not asked:
        return {}
    sizes = [len(t) for t, _ in asked]
    different = rows.select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", F.array_distinct(F.array(*texts))), " "))).alias("w"))
    different = different.filter(F.length("w").between(min(sizes) - 1, max(sizes) + 1) | F.col("w").rlike("[0-9]")).distinct()
    every = different.select(F.explode(cut(F.col("w"))).alias("w")).filter(F.length("w").between(min(sizes) - 1, max(sizes) + 1)).distinct()
    marks = [fits(F.col("w"), *a).alias(f"m{i}") for i, a in enumerate(asked)]
    some = F.greatest(*(m.cast("int") for m in marks), F.lit(0)) > 0
    found = every.filter(some).select("w", *marks).limit(most + 1).collect()
    if len(found) > most:
        return None
    return {a: [r["w"] for r in found if r[f"m{i}"]] for i, a in enumerate(asked)}

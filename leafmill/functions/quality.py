"""Text quality: words of a text, which of them are noise, and a score from 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import cleaned

#: Fixed value: a word starts with a letter or digit and may go on with these signs.
WORD = r"[a-z0-9\p{L}\p{N}][a-z0-9\p{L}\p{N}._+#/-]*+"
#: What most words are: 2 to 47 letters or digits, not all the same, and one sign more at most. None of them is noise.
ORDINARY = r"^(?!(.)\1{4,}\z)[a-z0-9\p{L}\p{N}]{2,47}+[._+#/-]?\z"


def words(text: Column) -> Column:
    """Lower-case words of a text; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def is_noise(word: Column) -> Column:
    """A single sign that is no digit, a word of over 48 characters, one character five times or more, nothing
    alphanumeric, or a long word that is nearly half punctuation. Ordinary words are told by one look."""
    n = F.length(word)
    signs = F.length(F.regexp_replace(word, r"[\p{L}\p{N}]", ""))
    return ~word.rlike(ORDINARY) & (((n == 1) & ~word.rlike(r"^\d$")) | (n > 48) | word.rlike(r"^(.)\1{4,}$") | (signs == n)
            | ((n >= 8) & (signs / n > 0.45)))


def noise_ratio(tokens: Column) -> Column:
    """1 without words. It stands in no branch, so that several columns of it count a text's noise once."""
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, is_noise)), F.size(tokens)), F.lit(1.0))


def score(ratio: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor((1 - ratio) * 100 + 0.5))).cast("int")


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def analysed(tokens: Column) -> list[Column]:
    """word_count, noise_ratio (3 digits) and quality, which uses the ratio as it is."""
    ratio = noise_ratio(tokens)
    return [F.size(tokens).cast("long").alias("word_count"), rounded(ratio, 3).alias("noise_ratio"),
            score(ratio).alias("quality")]


def built(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean_text, quality and noise_ratio of the clean text, and how many words the raw and the clean text have."""
    step = cleaned(docs, text, "clean_lines").withColumn("clean_text", F.array_join("clean_lines", "\n")).drop("clean_lines")
    step = step.withColumn("clean_words", words(F.col("clean_text")))
    count, ratio, score_ = analysed(F.col("clean_words"))
    # a text that cleaning leaves as it is has the same words
    raw = F.when(F.col(text) == F.col("clean_text"), F.size("clean_words")).otherwise(F.size(words(F.col(text)))).cast("long")
    return step.withColumns({"quality": score_, "raw_word_count": raw, "clean_word_count": count, "noise_ratio": ratio}).drop("clean_words")

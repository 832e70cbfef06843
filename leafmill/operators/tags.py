"""Keyword tags, title lines, categories and metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import BLANKS
from .rules import CATEGORIES


def tag_words(text: Column) -> Column:
    """Words of a-z and digits, with known misreadings put right; places count noise words too."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(words, lx.corrected)


def is_tag_noise(w: Column, stop=lx.STOP, noise=lx.OCR_NOISE, domain=lx.DOMAIN, common=lx.COMMON, as_it_is: bool = False) -> Column:
    """as_it_is: the word is one of tag_words(), so of a-z and digits only."""
    known = w.isin(*common, *domain)
    identifier, plausible = (lx.plain_identifier, lx.plain_plausible) if as_it_is else (lx.is_identifier, lx.is_plausible)
    return ~identifier(w) & (~F.length(w).between(3, 22) | w.isin(*stop, *noise) | w.rlike("[0-9]") | w.rlike(r"^(.)\1{2,}$")
                             | ~(known | plausible(w)))


def keyword_tags(docs: DataFrame, limit: int = 20, text: str = "text", stop=lx.STOP, noise=lx.OCR_NOISE, domain=lx.DOMAIN,
                 common=lx.COMMON) -> DataFrame:
    """doc_id, tag, score, rank: identifiers 100; domain words 4n + 12; dictionary words 2n + 6; other words seen three
    times or more 2n; each less a thousandth of its first place. Words are counted before anything is joined or ranked."""
    each = docs.select("doc_id", F.posexplode(tag_words(F.col(text))).alias("at", "tag"))
    kept = each.filter(~is_tag_noise(F.col("tag"), stop, noise, domain, common, True))
    seen = kept.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    w, n = F.col("tag"), F.col("n")
    score = (F.when(lx.plain_identifier(w), F.lit(100)).when(w.isin(*domain), n * 4 + 12).when(w.isin(*common), n * 2 + 6)
             .when((n >= 3) & lx.plain_plausible(w), n * 2)) - 0.001 * F.col("first")
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "first", "tag")
    return (seen.withColumn("score", score).filter("score is not null").withColumn("rank", F.row_number().over(order))
                .filter(F.col("rank") <= limit).select("doc_id", "tag", "score", "rank", "first"))


def title_lines(docs: DataFrame, limit: int = 5, among: int = 40, text: str = "text", stop=lx.STOP, noise=lx.OCR_NOISE, domain=lx.DOMAIN,
                common=lx.COMMON) -> DataFrame:
    """doc_id, line_no, score, title: the best of the first lines, by words of use, domain words, identifiers, letters
    and signs, and then in the document's order."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "_l")).select(
        "doc_id", "line_no", F.trim("_l").alias("line")).filter("line <> ''")
    first = Window.partitionBy("doc_id").orderBy("line_no")
    some = lines.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= among)
    n = F.length("line")
    alpha = F.length(F.regexp_replace("line", "[^A-Za-z0-9]", "")) / n
    signs = F.length(F.regexp_replace("line", r"[A-Za-z0-9\s]", "")) / n
    words = tag_words(F.col("line"))
    useful = F.filter(words, lambda w: ~is_tag_noise(w, stop, noise, domain, common, True))
    scored = some.filter(n.between(4, 80) & (alpha >= 0.45) & (signs <= 0.35)).select(
        "doc_id", "line_no", words.alias("_w"), useful.alias("_u"), alpha.alias("_a"), signs.alias("_s")).filter(F.size("_u") > 0)
    number = lambda test: F.size(F.filter("_u", test))
    score = (2 * F.size("_u") + 3 * number(lambda w: w.isin(*domain)) + 6 * number(lx.plain_identifier) + 2 * F.col("_a") - 3 * F.col("_s")
             - (F.size("_w") - F.size("_u")) - 0.08 * F.col("line_no"))
    cased = F.transform(F.array_distinct("_u"), lambda w: F.when(lx.plain_identifier(w), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no")
    return scored.select("doc_id", "line_no", score.alias("score"), F.array_join(cased, " ").alias("title")).withColumn(
        "_r", F.row_number().over(best)).filter(F.col("_r") <= limit).drop("_r")


def category(text: Column, weights: dict[str, dict[str, int]] = CATEGORIES) -> Column:
    """The category whose substrings weigh most; of equal ones the first; Unknown if none occurs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sums = [F.struct(sum((F.when(low.contains(t), w).otherwise(0) for t, w in terms.items()), F.lit(0)).alias("score"), F.lit(-i).alias("order"),
                     F.lit(name).alias("name")) for i, (name, terms) in enumerate(weights.items())]
    best = F.array_max(F.array(*sums))
    return F.when(best["score"] == 0, "Unknown").otherwise(best["name"])


def next_line_value(docs: DataFrame, word: str, text: str = "text") -> DataFrame:
    """doc_id, value: the non-empty line after the last non-empty line that contains the word; null if there is none.
    Blanks of any width are cut off a line's ends."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    # the array is one document's own: the last match and its next line need no window and no shuffle
    at = F.array_max(F.transform(lines, lambda x, i: F.when(F.lower(x).contains(word), i)))
    return docs.select("doc_id", F.get(lines, at + 1).alias("value"), at.alias("line_at"))

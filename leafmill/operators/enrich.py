"""Phrases and tags that enrich a document: key phrases, their order and their suppression, merged and edited tags, generated
titles, and which documents are due. Every array is one document's own, so its steps need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.identity import base_name, fingerprint
from ..functions.labels import phrase_form, tag_form

# Domain words that make no topic of a title.
NO_TOPIC = "document file notes page paper question unit".split()
#: Phrases looked at first, for each that is wanted.
AHEAD = 6


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _formed(phrases: Column) -> Column:
    return F.filter(F.transform(phrases, phrase_form), lambda p: p != "")


def _bound(value: Column, to) -> Column:
    """to(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), to), 0)


def _first_of(phrases: Column, limit: int, pick) -> Column:
    """pick(phrases), where no phrase counts after `limit` are picked: all are looked at only where the first AHEAD times
    `limit` don't give so many. Repeats pick nothing."""
    n = AHEAD * limit
    return _bound(phrases, lambda p: _bound(pick(F.slice(p, 1, n)), lambda some: F.when(
        (F.size(p) <= n) | (F.size(some) >= limit), some).otherwise(pick(F.array_distinct(p)))))


def different(phrases: Column, limit: int) -> Column:
    """The first `limit` different phrases in phrase_form(), none of them empty."""
    return _first_of(phrases, limit, lambda some: F.slice(F.array_distinct(_formed(some)), 1, limit))


def apart(phrases: Column, limit: int = 20) -> Column:
    """As different(), and without phrases that contain an accepted one or lie within one; the earlier phrase stays."""
    return _first_of(phrases, limit, lambda some: F.aggregate(
        _formed(some), _none("array<string>"),
        lambda kept, p: F.when((F.size(kept) >= limit) | F.exists(kept, lambda k: k.contains(p) | p.contains(k)), kept).otherwise(F.array_append(kept, p))))


def with_enrichment(titles: Column, keywords: Column, keyphrases: Column, nouns: Column) -> tuple[Column, Column]:
    """Title tags, then four key phrases, 14 in all; key phrases, then keyword tags, then six noun phrases, 32 in all."""
    none = _none("array<string>")
    t, k = F.coalesce(titles, none), F.coalesce(keywords, none)
    keys, some = different(F.coalesce(keyphrases, none), 20), different(F.coalesce(nouns, none), 16)
    return different(F.concat(t, F.slice(keys, 1, 4)), 14), different(F.concat(keys, k, F.slice(some, 1, 6)), 32)


def tag_added(tags: Column, tag: Column, most: int = 40) -> Column:
    """tags with tag_form(tag) at the end, if it isn't there yet."""
    both = F.array_append(F.coalesce(tags, _none("array<string>")), tag_form(tag))
    return F.slice(F.array_distinct(F.filter(both, lambda t: t != "")), 1, most)


def tag_removed(tags: Column, tag: Column) -> Column:
    return F.filter(F.coalesce(tags, _none("array<string>")), lambda t: tag_form(t) != tag_form(tag))


def generated_title(words: Column, domain=lx.DOMAIN) -> Column:
    """From an identifier and what the document is, or from two or more topics; empty if the words give neither."""
    ids = F.filter(words, lx.is_identifier)
    topics = F.filter(words, lambda w: w.isin(*domain) & ~w.isin(*NO_TOPIC))
    has = lambda w: F.array_contains(words, w)
    rest = F.when(has("question") & has("paper"), F.array(F.lit("question"), F.lit("paper"))).when(has("assignment"), F.array(F.lit("assignment"))).when(
        F.size(topics) > 0, F.slice(topics, 1, 2)).otherwise(F.array(F.lit("notes")))
    parts = F.when(F.size(ids) > 0, F.concat(F.slice(ids, 1, 1), rest)).when(has("turing") & has("machine"), F.array(*map(F.lit, ("turing", "machine", "notes")))).when(
        F.size(topics) >= 2, F.concat(F.slice(topics, 1, 3), F.array(F.lit("notes")))).otherwise(_none("array<string>"))
    return F.array_join(F.transform(parts, title_case), " ")


def title_case(word: Column) -> Column:
    """Identifiers in capitals; of other words the first letter, the rest as it is."""
    return F.when(lx.is_identifier(word), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100)))


def useful_words(text: Column, stop=lx.STOP, noise=lx.OCR_NOISE, domain=lx.DOMAIN, common=lx.COMMON) -> Column:
    """Words of 3 to 24 of a-z, digits and hyphens that look like words or identifiers."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]++", " "), r"\s+")
    bare = lambda w: F.replace(w, F.lit("-"), F.lit(""))
    return F.filter(words, lambda w: F.length(w).between(3, 24) & ~w.isin(*stop, *noise) & ~w.rlike("^[0-9]+$")
                    & (w.isin(*domain, *common) | lx.plain_plausible(bare(w)) | lx.plain_identifier(bare(w))))


def keyphrases(docs: DataFrame, limit: int = 20, text: str = "text", known: str | None = None, stop=lx.STOP, noise=lx.OCR_NOISE,
               domain=lx.DOMAIN, common=lx.COMMON) -> DataFrame:
    """doc_id, keyphrases: one to three words, by count (times 3 a word for phrases), how early they come and how many
    of their words are known; the best `limit` of which none contains another. Phrases need a domain word, an
    identifier or one of the document's tags (`known`). Equal scores go by first place, which counts threes, then
    twos, then words.

    Candidates are counted in the document's row, where equal ones lie together once they are sorted.
    """
    tags = F.col(known) if known else _none("array<string>")
    base = docs.select("doc_id", useful_words(F.col(text), stop, noise, domain, common).alias("_w"), F.coalesce(tags, _none("array<string>")).alias("_k"))
    bare = lambda w: F.replace(w, F.lit("-"), F.lit(""))
    mark = lambda w: w.isin(*domain) | lx.plain_identifier(bare(w)) | (F.array_contains("_k", w) if known else F.lit(False))
    marks = base.select("doc_id", "_w", F.transform("_w", mark).alias("_m"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(_none("array<int>"))
        number = lambda i: sum((F.get("_m", i + (k - 1)).cast("int") for k in range(n)), F.lit(0))
        some = starts if n == 1 else F.filter(starts, lambda i: number(i) > 0)
        return F.transform(some, lambda i: F.struct(F.concat_ws(" ", *(F.get("_w", i + (k - 1)) for k in range(n))).alias("phrase"), number(i).alias("known"), F.lit(n).alias("n_words")))

    # places count the phrases of three words that hold a known one first, then those of two, then words
    placed = F.transform(F.concat(runs(3), runs(2), runs(1)), lambda r, i: F.struct(r["phrase"].alias("phrase"), i.alias("at"), r["known"].alias("known"), r["n_words"].alias("k")))
    each = marks.select("doc_id", F.filter(placed, lambda r: F.length(r["phrase"]) <= 60).alias("_a"))
    if not docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():  # rows of one id count together
        each = docs.select("doc_id").join(each.groupBy("doc_id").agg(F.flatten(F.collect_list("_a")).alias("_a")), "doc_id", "left")
    each = each.select("doc_id", F.sort_array(F.coalesce("_a", _none("array<struct<phrase:string,at:int,known:int,k:int>>"))).alias("_a"))
    new = F.filter(F.when(F.size("_a") > 0, F.sequence(F.lit(1), F.size("_a"))).otherwise(_none("array<int>")),
                   lambda i: (i == 1) | (F.get("_a", i - 1)["phrase"] != F.get("_a", i - 2)["phrase"]))
    each = each.select("doc_id", "_a", new.alias("_s"))
    ends = F.concat(F.slice(F.col("_s"), F.lit(2), F.size("_s")), F.array(F.size("_a") + 1))

    def scored(r: Column, n: Column) -> Column:
        score = n * F.when(r["k"] > 1, r["k"] * 3).otherwise(1) + 2 / (1 + r["at"] / 80) + 2 * r["known"]
        return F.struct((-score).alias("s"), r["at"].alias("first"), r["phrase"].alias("phrase"))

    best = F.sort_array(F.zip_with("_s", F.slice(ends, 1, F.size("_s")), lambda a, b: scored(F.get("_a", a - 1), b - a)))
    best = each.select("doc_id", best.alias("_c")).select("doc_id", F.transform("_c", lambda c: c["phrase"]).alias("_c"))
    return best.select("doc_id", apart(F.col("_c"), limit).alias("keyphrases"))


def due(docs: DataFrame, enriched: DataFrame, text: str = "text") -> DataFrame:
    """doc_id of documents with text whose enrichment (doc_id, keyword_fingerprint, vector_fingerprint, has_vector) is
    missing, was made of another text, or has no vector."""
    now = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).filter(F.trim("_t") != "").select("doc_id", fingerprint(F.col("_t")).alias("_f"))
    both = now.join(enriched, "doc_id", "left")
    fresh = F.col("keyword_fingerprint").eqNullSafe(F.col("_f")) & F.col("vector_fingerprint").eqNullSafe(F.col("_f")) & F.coalesce("has_vector", F.lit(False))
    return both.filter(~fresh).select("doc_id")


def usable_vectors(candidates: DataFrame) -> DataFrame:
    """candidates (doc_id, vector, made_of, fingerprint) with `vector` null unless it is there and of today's text (or
    of no known text), and `all_fresh`: whether that holds for every candidate. (Lengths and numbers are checked where
    vectors are compared: vectors.semantic().)"""
    fresh = F.coalesce(F.size("vector") > 0, F.lit(False)) & (F.coalesce(F.nullif("made_of", F.lit("")), F.col("fingerprint")) == F.col("fingerprint"))
    rows = candidates.withColumn("_ok", F.coalesce(fresh, F.lit(False)))
    every = rows.agg(F.min("_ok").alias("all_fresh"))  # one row
    return rows.join(F.broadcast(every)).withColumn("vector", F.when(F.col("_ok"), F.col("vector"))).drop("_ok")


def embedded_text(title: Column, text: Column, length: int = 4000) -> Column:
    """What a vector is made of: the title, and the start of the text on the next line."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, length))


def for_workers(docs: DataFrame) -> DataFrame:
    """id, file, title, text, vector as a model's worker takes them: the file is the path, or else the name, or else the id;
    the title its name; vectors without components are left out."""
    file = F.coalesce(F.nullif("file_path", F.lit("")), F.nullif("primary_path", F.lit("")), F.nullif("file_name", F.lit("")), "document_id")
    text = F.coalesce(F.nullif("clean_text", F.lit("")), "text", F.lit(""))
    return docs.select(F.col("document_id").alias("id"), file.alias("file"), F.coalesce(F.nullif("file_name", F.lit("")), base_name(file)).alias("title"), text.alias("text"),
                       F.when(F.size("vector") > 0, F.col("vector")).alias("vector"))


def with_output(docs: DataFrame, output: DataFrame) -> DataFrame:
    """docs with a worker's output for their file; documents without any have empty lists."""
    none = F.array().cast("array<string>")
    rows = docs.join(output.select("file", "keyphrases", "nouns"), "file", "left")
    return rows.withColumns({"keyphrases": F.coalesce("keyphrases", none), "nouns": F.coalesce("nouns", none)})

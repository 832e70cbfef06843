"""Documents as readers see them: joined with their pages, paths and folders, summed up for lists and results, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, quality
from . import folders as fo


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def with_defaults(documents: DataFrame) -> DataFrame:
    """documents whose stored JSON is decoded: lists of tags that are missing or broken are empty, metadata an empty map,
    and a category is Unknown unless it is known."""
    none = F.array().cast("array<string>")
    return documents.withColumns({
        "title_tags": F.coalesce(F.from_json("title_tags_json", "array<string>"), none),
        "keyword_tags": F.coalesce(F.from_json("keyword_tags_json", "array<string>"), none),
        "metadata": F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>")),
        "category": F.coalesce(_filled(F.col("category")), F.lit("Unknown")),
    }).drop("title_tags_json", "keyword_tags_json", "metadata_json")


def flattened(documents: DataFrame, pages: DataFrame, paths: DataFrame) -> DataFrame:
    """documents with paths, pages (in order), n_pages, and the text and clean text of their pages, or else their own; the
    quality columns are the stored ones, or else those of that text. A document's pages and paths are its own few."""
    each = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", "clean_text", "status"))).alias("pages"))
    named = paths.groupBy("document_id").agg(F.array_sort(F.collect_set("file_path")).alias("paths"))
    join = lambda pick: _filled(F.array_join(F.filter(F.transform("pages", pick), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n"))
    rows = documents.join(each, "document_id", "left").join(named, "document_id", "left")
    whole = F.coalesce(join(lambda p: p["text"]), "text", F.lit(""))
    clean = F.coalesce(join(lambda p: F.coalesce(_filled(p["clean_text"]), p["text"])), _filled(F.col("clean_text")))
    rows = rows.withColumns({"text": whole, "stored_clean": clean, "n_pages": F.when(F.size("pages") > 0, F.size("pages").cast("long")).otherwise(F.col("indexed_pages"))})
    made = quality.built(rows.drop("clean_text"))
    return made.select(
        *(c for c in documents.columns if c not in ("text", "clean_text", "indexed_pages", "text_quality")), "text", F.coalesce("stored_clean", "clean_text").alias("clean_text"),
        F.coalesce(F.col("text_quality"), F.col("quality")).alias("text_quality"), "raw_word_count", "clean_word_count", "noise_ratio",
        F.col("n_pages").alias("indexed_pages"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), "pages")


def listed(documents: DataFrame) -> DataFrame:
    """The last changed first, and then by name."""
    return documents.orderBy(F.desc("updated_at"), "file_name")


def of_id(documents: DataFrame, document_id: str) -> DataFrame:
    return documents.filter(F.col("document_id") == document_id)


def of_hash(documents: DataFrame, file_hash: str) -> DataFrame:
    return documents.filter(F.col("file_hash") == file_hash)


def summary(documents: DataFrame, score: Column | None = None, tags: bool = False) -> DataFrame:
    """documents without their texts: a preview of the clean text, or else of the text, or else (with `tags`) the title
    tags; whether there is any text; and a result's score."""
    start = lambda c: F.substring(_filled(F.col(c)), 1, 320)
    last = [F.array_join("title_tags", " | ")] if tags else []
    shown = F.coalesce(start("clean_text"), start("text"), *last, F.lit(""))
    has = F.coalesce(_filled(F.col("text")), _filled(F.col("clean_text"))).isNotNull()
    rest = [c for c in documents.columns if c not in ("text", "clean_text", "pages")]
    return documents.select(*rest, shown.alias("preview"), has.alias("has_full_text"), *([score.alias("score")] if score is not None else []))


def found(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """summary() of the documents that hits (document_id, score) name."""
    return summary(documents.join(hits.select("document_id", F.col("score").alias("hit")), "document_id"), F.col("hit")).drop("hit")


def found_by_meaning(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """As found(), for hits (file_path, similarity) of a vector search: by path with one kind of slash; hits without a
    document go; the score is the similarity in hundredths of a percent."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\\\", "/"), r"/(\./)+|//+", "/")
    own = documents.withColumn("plain_path", plain(F.coalesce(_filled(F.col("file_path")), F.col("primary_path"), F.lit(""))))
    rows = own.join(hits.select(plain(F.col("file_path")).alias("plain_path"), "similarity"), "plain_path").drop("plain_path")
    return summary(rows, F.floor(F.coalesce("similarity", F.lit(0.0)) * 10000 + 0.5) / 100, tags=True)


def folder_overrides(overrides: DataFrame, folder_id: str | None = None) -> DataFrame:
    """Keyword overrides of one folder or of all, in their order."""
    some = overrides if folder_id is None else overrides.filter(F.col("folder_id") == folder_id)
    return some.orderBy("folder_id", "role", "keyword")


def document_overrides(overrides: DataFrame, document_id: str | None = None) -> DataFrame:
    some = overrides if document_id is None else overrides.filter(F.col("document_id") == document_id)
    return some.orderBy("document_id", "action", "folder_id")


def organised(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """The organisation that is stored, and for documents without one the computed one."""
    return stored.unionByName(computed.join(stored.select("doc_id"), "doc_id", "left_anti"))


def assigned(suggestions: DataFrame, folders: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, folder_id, confidence, is_primary, source of suggestions (doc_id, folder_ids, primary_folder, confidence)
    as they are kept: folders that aren't active go; without its primary folder, a document's first active folder by
    order and path is primary; documents without any are in the first active folder but all-files."""
    live = folders.filter("deleted_at is null").select("folder_id", "display_path", "sort_order")
    rows = suggestions.select("doc_id", "primary_folder", "confidence", F.explode(F.array_distinct("folder_ids")).alias("folder_id")).join(F.broadcast(live), "folder_id")
    key = F.struct((F.col("folder_id") != F.col("primary_folder")).alias("other"), "sort_order", "display_path", "folder_id")
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("r"), F.max("confidence").alias("c"))  # a few folders a document
    spare = live.filter("folder_id <> 'all-files'").agg(F.min(F.struct(F.lit(False).alias("other"), "sort_order", "display_path", "folder_id")).alias("spare"))  # one row
    every = documents.select("doc_id").join(each, "doc_id", "left").join(F.broadcast(spare))
    there = F.coalesce("r", F.array_compact(F.array("spare")))
    return every.select("doc_id", F.posexplode(there).alias("at", "x"), F.coalesce("c", F.lit(0.0)).alias("confidence")).select(
        "doc_id", F.col("x.folder_id").alias("folder_id"), "confidence", (F.col("at") == 0).alias("is_primary"), F.lit("auto").alias("source"))


def detail(documents: DataFrame, pages: DataFrame, paths: DataFrame, assignments: DataFrame, folders: DataFrame, document_id: str) -> DataFrame:
    """One document in full, with its organisation. The filter goes ahead of every join."""
    own = lambda df: df.filter(F.col("document_id") == document_id)
    there = fo.organisation(own(assignments).withColumnRenamed("document_id", "doc_id"), folders).withColumnRenamed("doc_id", "document_id")
    return flattened(own(documents), own(pages), own(paths)).join(there, "document_id", "left")

"""What is worked out again after a change: a document's state from its pages, and where documents belong.

The tables that go in are read more than once, so a state is to be written before the next change is made to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from . import folders as fo
from . import organise, store, tags, views


def tagged(docs: DataFrame, **words) -> DataFrame:
    """doc_id, title_tags, keyword_tags of docs (doc_id, text); lists without tags are empty. Titles come by score, as shown
    with three digits, and lines of one score in the document's order. `words`: the word lists."""
    titles = tags.title_lines(docs, **words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-quality.rounded(F.col("score"), 3)).alias("s"), "line_no", "title"))).alias("t"))
    keys = tags.keyword_tags(docs, **words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("k"))
    none = F.array().cast("array<string>")
    return docs.select("doc_id").join(titles, "doc_id", "left").join(keys, "doc_id", "left").select(
        "doc_id", F.coalesce(F.array_distinct(F.transform("t", lambda x: x["title"])), none).alias("title_tags"), F.coalesce(F.transform("k", lambda x: x["tag"]), none).alias("keyword_tags"))


def built(extracted: DataFrame, rules: dict | None = None, **words) -> DataFrame:
    """extracted (doc_id, text, clean_text and more) with what is told from the clean text, or else from the text: tags and
    category; and with a status of done where there is none."""
    text = F.coalesce(F.nullif("clean_text", F.lit("")), "text", F.lit(""))
    more = tagged(extracted.select("doc_id", text.alias("text")), **words)
    found = tags.category(text, rules) if rules else tags.category(text)
    rows = extracted.withColumn("category", found)
    if "status" in rows.columns:
        rows = rows.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("done")))
    return rows.join(more, "doc_id")


def synced(documents: DataFrame, pages: DataFrame, paths: DataFrame, jobs: DataFrame, **words) -> DataFrame:
    """document_id, title_tags, keyword_tags, clean_text, quality columns, indexed_pages and status, as the pages and jobs
    of today have them. `words` are the word lists of tags."""
    whole = views.flattened(documents, pages, paths).select("document_id", "clean_text", "text_quality", "raw_word_count", "clean_word_count", "noise_ratio")
    more = tagged(whole.select(F.col("document_id").alias("doc_id"), F.col("clean_text").alias("text")), **words).withColumnRenamed("doc_id", "document_id")
    state = store.status(documents, pages, jobs).select("document_id", "indexed_pages", "status")
    return whole.join(more, "document_id").join(state, "document_id").select(
        "document_id", "title_tags", "keyword_tags", "clean_text", "text_quality", "raw_word_count", "clean_word_count", "noise_ratio", "indexed_pages", "status")


def organised(docs: DataFrame, folders: DataFrame, keywords: DataFrame | None = None, single: DataFrame | None = None) -> DataFrame:
    """doc_id, folder_id, confidence, is_primary, source of every document: suggested with the users' keywords (folder_id,
    keyword, role, weight), kept in active folders, and changed by edits of single documents (doc_id, folder_id, action)."""
    kept = views.assigned(organise.suggested(docs, overrides=keywords), folders, docs)
    return kept if single is None else store.overridden(kept, single, folders)


def organised_again(docs: DataFrame, assigned: DataFrame, folders: DataFrame, keywords: DataFrame, single: DataFrame | None, folder_id: str, keyword: str,
                    text: list[str]) -> DataFrame:
    """assigned after one keyword of a folder changed: only documents that have the keyword, or are in the folder, are
    organised anew; the rest stays as it is."""
    due = fo.touched(docs, assigned, folder_id, keyword, text)
    some = docs.join(due, "doc_id", "left_semi")
    new = organised(some, folders, keywords, None if single is None else single.join(due, "doc_id", "left_semi"))
    return assigned.join(due, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def without_folder(docs: DataFrame, assigned: DataFrame, folders: DataFrame, keywords: DataFrame, single: DataFrame, folder_id: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(folders, assigned) after a folder and all below it are deleted: its assignments and overrides go, and the documents
    that were in it are organised anew."""
    gone = fo.subtree(folders, folder_id)
    due = assigned.join(gone, "folder_id", "left_semi").select("doc_id").distinct()
    left = fo.deleted(folders, folder_id, at)
    rest = lambda df: df.join(gone, "folder_id", "left_anti")
    new = organised(docs.join(due, "doc_id", "left_semi"), left, rest(keywords), rest(single).join(due, "doc_id", "left_semi"))
    return left, assigned.join(due, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)

"""Ids from content, and parts of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(hash_: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(hash_, 1, 24))


def page_id(document: Column, number: Column) -> Column:
    return F.format_string("%s_page_%05d", document, number)


def job_id(document: Column, number: Column) -> Column:
    return F.format_string("%s_ocr_%05d", document, number)


def fingerprint(text: Column) -> Column:
    """Of the trimmed text, to tell whether derived data is fresh."""
    return F.substring(F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256), 1, 24)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.[^.]+$", 0)


def slug(name: Column) -> Column:
    """At most 48 characters; `folder` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 48), F.lit("")), F.lit("folder"))

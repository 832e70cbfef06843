"""JSON snapshots of a library, in and out: today's object of sections, and the older array of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, quality
from . import large_json, versions

QUALITY = "textQuality int, text_quality int, rawWordCount long, raw_word_count long, cleanWordCount long, clean_word_count long, noiseRatio double, noise_ratio double"
DOCUMENT = f"""documentId string, fileHash string, fileName string, filePath string, primaryPath string, paths array<string>, titleTags array<string>, keywordTags array<string>, category string,
metadata map<string,string>, text string, ocrText string, cleanText string, clean_text string, {QUALITY}, totalPages int, indexedPages int, status string, scannedAt string, updatedAt string"""
PAGE = f"documentId string, fileHash string, filePath string, pageNumber int, text string, embeddedText string, ocrText string, cleanText string, clean_text string, {QUALITY}, hasImage boolean, status string"
JOB = "jobId string, documentId string, fileHash string, filePath string, pageNumber int, status string, attempts int, error string, createdAt string"
#: Sections whose rows are kept as they are, with their columns.
PLAIN = {
    "paths": "documentId string, filePath string", "tags": "documentId string, tagType string, tag string",
    "virtualFolders": "folderId string, name string, parentId string, path string, source string, sortOrder int, deletedAt string",
    "documentVirtualFolders": "documentId string, folderId string, confidence double, documentType string, subject string, isPrimary boolean, source string",
    "folderKeywordOverrides": "folderId string, keyword string, role string, weight double, source string", "documentFolderOverrides": "documentId string, folderId string, action string, source string",
    "embeddings": "documentId string, model string, fingerprint string, vector array<double>", "metadata": "key string, value string",
}
SECTIONS = ["documents", "pages", "jobs", *PLAIN]


def _filled(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def plain_path(path: Column) -> Column:
    """One kind of slash, and no doubled ones; null for an empty path."""
    return F.nullif(F.regexp_replace(F.regexp_replace(path, r"\\\\", "/"), "/{2,}", "/"), F.lit(""))


def _with_quality(rows: DataFrame) -> DataFrame:
    """Quality columns as stored, or else those of the text."""
    made = quality.built(rows.withColumns({"given_clean": _filled("cleanText", "clean_text"), "given_quality": F.coalesce("textQuality", "text_quality"),
                                           "given_raw": F.coalesce("rawWordCount", "raw_word_count"), "given_words": F.coalesce("cleanWordCount", "clean_word_count"),
                                           "given_noise": F.coalesce("noiseRatio", "noise_ratio")}).drop("clean_text", "raw_word_count", "clean_word_count", "noise_ratio"))
    return made.withColumns({"clean_text": F.coalesce("given_clean", "clean_text"), "text_quality": F.coalesce("given_quality", "quality"), "raw_word_count": F.coalesce("given_raw", "raw_word_count"),
                             "clean_word_count": F.coalesce("given_words", "clean_word_count"), "noise_ratio": F.coalesce("given_noise", "noise_ratio")})


def documents(rows: DataFrame, now: Column) -> DataFrame:
    """Documents as they are kept. One without a hash gets one from its path or name, one without an id gets it from its
    hash; its paths are all that it names, each once; tags that are missing are empty."""
    none = F.array().cast("array<string>")
    name = _filled("filePath", "fileName")
    hashed = F.coalesce(_filled("fileHash"), F.concat(F.lit("legacy_"), F.substring(F.lower(F.hex(F.encode(F.coalesce(name, F.lit("")), "UTF-8"))), 1, 48)))
    primary, path = plain_path(_filled("primaryPath", "filePath")), plain_path(_filled("filePath", "primaryPath"))
    every = F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce("paths", none), plain_path), F.array(primary), F.array(path))))
    step = rows.withColumns({"file_hash": hashed, "text": F.coalesce(_filled("text", "ocrText"), F.lit("")), "primary_path": primary, "file_path": path, "all_paths": every})
    return _with_quality(step).select(
        F.coalesce(_filled("documentId"), identity.document_id(F.col("file_hash"))).alias("document_id"), "file_hash", F.col("fileName").alias("file_name"), "primary_path", "file_path",
        F.col("all_paths").alias("paths"), F.coalesce("titleTags", none).alias("title_tags"), F.coalesce("keywordTags", none).alias("keyword_tags"),
        F.coalesce(_filled("category"), F.lit("Unknown")).alias("category"), "metadata", "text", "clean_text", "text_quality", "raw_word_count", "clean_word_count", "noise_ratio",
        F.col("totalPages").alias("total_pages"), F.col("indexedPages").alias("indexed_pages"), F.coalesce(_filled("status"), F.lit("done")).alias("status"),
        F.coalesce(_filled("updatedAt", "scannedAt"), now).alias("updated_at"))


def pages(rows: DataFrame) -> DataFrame:
    """Pages as they are kept: a page without text has its embedded and its recognised one."""
    text = F.coalesce(_filled("text"), F.concat_ws("\n\n", _filled("embeddedText"), _filled("ocrText")))
    return _with_quality(rows.withColumn("text", text)).select(
        F.col("documentId").alias("document_id"), F.col("pageNumber").alias("page_number"), plain_path(F.col("filePath")).alias("file_path"), "text", "clean_text", "text_quality", "raw_word_count",
        "clean_word_count", "noise_ratio", F.coalesce("hasImage", F.lit(False)).alias("has_image"), F.coalesce("status", F.lit("done")).alias("status"))


def _made(rows, now: Column | None) -> dict[str, DataFrame]:
    """The sections, from rows(name, columns). Jobs that are done go, and so do texts of documents that have pages."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if now is None else now
    out = {"pages": pages(rows("pages", PAGE)), "jobs": rows("jobs", JOB).filter(F.coalesce("status", F.lit("")) != "done")}
    paged = out["pages"].select("document_id").distinct().withColumn("paged", F.lit(True))
    docs = documents(rows("documents", DOCUMENT), now).join(paged, "document_id", "left")
    out["documents"] = docs.withColumn("text", F.when(F.col("paged").isNull(), F.col("text"))).drop("paged")
    return out | {name: rows(name, columns) for name, columns in PLAIN.items()}


def parsed(texts: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The sections of snapshots (`value`: a whole JSON text a row). An array is a list of documents; what is neither that
    nor an object has no rows. A snapshot is one row here; read() takes files of any size."""
    first = F.substring(F.ltrim("value"), 1, 1)

    def rows(name: str, columns: str) -> DataFrame:
        # both forms in one pass: a filter for each would make and parse every text once more
        several = f"array<struct<{_ddl(columns)}>>"
        held = F.when(first == "{", F.from_json("value", f"struct<{name}:{several}>")[name])
        if name == "documents":
            held = held.when(first == "[", F.from_json("value", several))
        return texts.select(F.explode(held).alias("r")).select("r.*")

    return _made(rows, now)


def _ddl(columns: str) -> str:
    """`a string, b int` as the inside of a struct type."""
    parts, depth, word = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.split(maxsplit=1)
            parts.append(f"{name}:{kind}")
            word = ""
        else:
            word += c
    return ",".join(parts)


def read(spark: SparkSession, path: str, now: Column | None = None) -> dict[str, DataFrame]:
    """The sections of the snapshot files at path, however large a file is: many tasks read its elements, which are written
    by section, so that no section parses another's."""
    at = f"{versions.shared(spark)}/snapshot-{uuid.uuid4().hex}"
    large_json.elements(spark, path).select("section", "value").filter(F.col("section").isin(SECTIONS)).write.partitionBy("section").parquet(at)
    held = spark.read.schema("value string, section string").parquet(at)
    return _made(lambda name, columns: held.filter(F.col("section") == name).select(F.from_json("value", f"struct<{_ddl(columns)}>").alias("r")).select("r.*"), now)


def write(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as JSON lines in a folder of its own."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def loaded(documents_: DataFrame, snapshot: dict[str, DataFrame]) -> DataFrame:
    """The documents of a table, or where it has none those of the snapshot."""
    return snapshot["documents"] if documents_.isEmpty() else documents_

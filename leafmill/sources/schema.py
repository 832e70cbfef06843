"""The tables of a library, and a folder of Parquet files that holds them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions

QUALITY = "text_quality int, raw_word_count long, clean_word_count long, noise_ratio double"
# The columns that snapshots and queries expect.
TABLES = {
    "app_metadata": "key string, value string",
    "documents": f"""document_id string, file_hash string, file_name string, primary_path string, title_tags array<string>, keyword_tags array<string>, category string, metadata map<string,string>,
        text string, clean_text string, {QUALITY}, embedding array<double>, embedding_model string, embedding_fingerprint string, total_pages int, indexed_pages int, status string, scanned_at string, updated_at string""",
    "document_paths": "document_id string, file_path string",
    "pages": f"page_id string, document_id string, file_hash string, file_path string, page_number int, text string, clean_text string, {QUALITY}, has_image boolean, status string, processed_at string",
    "jobs": "job_id string, document_id string, file_hash string, file_path string, page_number int, status string, attempts int, error string, created_at string, updated_at string",
    "tags": "document_id string, tag_type string, tag string",
    "folders": "folder_id string, name string, parent_id string, display_path string, source string, sort_order int, updated_at string, deleted_at string",
    "document_folders": "document_id string, folder_id string, confidence double, reasons array<string>, document_type string, subject string, is_primary boolean, source string, updated_at string",
    "folder_keyword_overrides": "folder_id string, keyword string, role string, weight double, source string, updated_at string",
    "document_folder_overrides": "document_id string, folder_id string, action string, source string, updated_at string",
}


#: What tells the rows of a table apart.
KEYS = {"app_metadata": ["key"], "documents": ["document_id"], "document_paths": ["document_id", "file_path"], "pages": ["document_id", "page_number"], "jobs": ["document_id", "page_number"],
        "tags": ["document_id", "tag_type", "tag"], "folders": ["folder_id"], "document_folders": ["document_id", "folder_id"], "folder_keyword_overrides": ["folder_id", "keyword"],
        "document_folder_overrides": ["document_id", "folder_id"]}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns, in order and type; columns that an older version lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def saved(tables: dict[str, DataFrame], path: str, after: int | None = None) -> int:
    """All tables as one new version, whose number it gives: each as Parquet in a folder of its own, one that isn't given
    empty. Readers see all of it or none. after: the version that the tables were made from (the last one, if not given);
    if another writer has made the next one meanwhile, this one fails with versions.Taken and changes nothing."""
    spark = next(iter(tables.values())).sparkSession
    version = (max(versions.versions(spark, path), default=0) if after is None else after) + 1
    folder = f"{version}-{uuid.uuid4().hex}"
    for name in TABLES:
        (conformed(tables[name], name) if name in tables else empty(spark, name)).write.parquet(f"{path}/{folder}/{name}")
    versions.put(spark, path, version, {"folder": folder})
    return version


def loaded(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last version that is whole, older kinds of tables too; empty ones where there is none."""
    version, state = versions.got(spark, path)
    if not version:
        return {name: empty(spark, name) for name in TABLES}
    return {name: conformed(spark.read.parquet(f"{path}/{state['folder']}/{name}"), name) for name in TABLES}

"""Files that arrive, taken into a stored library: equal contents are one document, and its paths are merged.

A file is the document of its content, if that is stored; else the document that has its path, whose content it
replaces, unless other paths still have that content; else a new one, named by its content. Files of one content in a batch are one document, whatever their paths
say. A path that was another document's moves. A batch that comes again changes nothing, and neither do files that are
as they are stored: no version is made.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, quality
from ..sources import library as lib
from ..sources import versions
from ..sources.versions import Taken


def changes(library: lib.Library, files: DataFrame, at: str) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """What files (file_path, file_hash, text, at) change: documents and document_paths. Of rows that repeat a path, the
    latest counts. Which file is which document is told without texts and written below `at`; of texts, only those of new
    documents move."""
    spark = files.sparkSession
    docs, paths = library.table("documents"), library.table("document_paths")
    given = files.filter("file_path IS NOT NULL AND file_hash IS NOT NULL")
    last = given.groupBy("file_path").agg(F.max(F.struct("at", "file_hash")).alias("r")).select("file_path", "r.*")
    by_hash = docs.groupBy("file_hash").agg(F.min("document_id").alias("_h"))
    by_path = paths.groupBy("file_path").agg(F.min("document_id").alias("_p"))
    last.join(by_hash, "file_hash", "left").join(by_path, "file_path", "left").write.parquet(f"{at}/met")
    met = spark.read.parquet(f"{at}/met")
    # a document whose content some path still has, stored or in these files, keeps it
    known = met.filter("_p IS NOT NULL")
    whole = known.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).join(paths.groupBy(F.col("document_id").alias("_p")).agg(F.count(F.lit(1)).alias("_all")), "_p").filter("_n = _all")
    free = whole.select("_p").join(met.filter("_h IS NOT NULL").select(F.col("_h").alias("_p")).distinct(), "_p", "left_anti")
    met = met.drop("_p").join(known.select("file_path", "_p").join(free, "_p"), "file_path", "left")
    last_of = F.struct("at", "file_path")
    own = met.groupBy("file_hash").agg(F.coalesce(F.min("_h"), F.min("_p")).alias("document_id"), F.min("_h").isNull().alias("_new"), F.min_by("file_path", last_of).alias("primary_path"),
                                       F.max(last_of).alias("_last"), F.min("at").alias("first_at"))
    # a document whose path has two contents by now is its first one's; the others are new. Files without a document
    # are apart, each content by itself
    apart = Window.partitionBy("document_id", F.when(F.col("document_id").isNull(), F.col("file_hash")))
    own = own.withColumn("_first", F.min("file_hash").over(apart)).withColumn("document_id", F.when(
        F.col("document_id").isNull() | F.col("_new") & (F.col("_first") != F.col("file_hash")), identity.document_id(F.col("file_hash"))).otherwise(F.col("document_id"))).drop("_first")
    own.write.parquet(f"{at}/own")
    own = spark.read.parquet(f"{at}/own")
    due = own.filter("_new").select("*", F.col("_last.file_path").alias("file_path"), F.col("_last.at").alias("_at")).drop("_last")
    texts = given.select("file_path", "file_hash", F.coalesce("text", F.lit("")).alias("text"), F.col("at").alias("_from"))
    same = (texts["file_path"] == due["file_path"]) & (texts["file_hash"] == due["file_hash"]) & texts["_from"].eqNullSafe(due["_at"])
    new = quality.built(texts.join(due, same).select("document_id", due["file_hash"], "primary_path", "text", "first_at"))
    rows = new.select("document_id", "file_hash", identity.base_name(F.col("primary_path")).alias("file_name"), "primary_path", F.lit("Unknown").alias("category"), "text", "clean_text", F.col("quality").alias("text_quality"),
                      "raw_word_count", "clean_word_count", "noise_ratio", F.lit("done").alias("status"), F.col("first_at").cast("string").alias("scanned_at"), F.col("first_at").cast("string").alias("updated_at"))
    pairs = met.select("file_path", "file_hash").join(own.select("file_hash", "document_id"), "file_hash")
    moved = paths.join(pairs.select("file_path", F.col("document_id").alias("_d")), "file_path").filter("document_id <> _d").select("document_id", "file_path")
    fresh = pairs.select("document_id", "file_path").join(paths, ["document_id", "file_path"], "left_anti")
    return {"documents": (rows, None), "document_paths": (fresh, moved)}


def taken_in(path: str, files: DataFrame, mark: tuple[str, str] | None = None, tries: int = 5) -> lib.Library:
    """The library at path after files. If another writer is faster, it is read again and the files are resolved anew.
    A mark that the library has already means that this batch is in it."""
    for left in reversed(range(tries)):
        library = lib.opened(files.sparkSession, path)
        if mark and library.state["marks"].get(mark[0]) == mark[1]:
            return library
        at = f"{path}/resolved-{uuid.uuid4().hex}"
        try:
            return library.changed(changes(library, files, at), mark)
        except Taken:
            if not left:
                raise
        finally:
            versions.dropped(files.sparkSession, at)
    return lib.opened(files.sparkSession, path)


def ingesting(files: DataFrame, path: str, checkpoint: str, name: str = "ingest"):
    """A writer (to be started) that takes a stream of files (file_path, file_hash, text, at) into the library at path."""
    def batch(df: DataFrame, number: int) -> None:
        rows = df.persist()
        try:
            total = rows.agg(F.sum(F.xxhash64("file_path", "file_hash").cast("decimal(38,0)"))).head()[0]
            if total is not None:
                taken_in(path, rows, (name, f"{number} {total}"))
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)

"""The relational side: identity and copies, upserts, folder trees, overrides, pages and the job queue.

Every change is a function of the state before it: DataFrames in, a DataFrame out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order. Upserts are a union and this."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows replace those of the same key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_new")]).drop("_new")


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def by_content(docs: DataFrame, key: Column) -> DataFrame:
    """file_hash, primary_id, n, ids: equal contents are one document, named by its smallest id. Ids are summed up
    map-side."""
    return docs.groupBy(key.alias("file_hash")).agg(F.min("doc_id").alias("primary_id"), F.count(F.lit(1)).alias("n"))


def merged_paths(docs: DataFrame) -> DataFrame:
    """file_hash, document_id, paths: the paths of equal files, the primary one first (first_seen decides)."""
    return docs.groupBy("file_hash").agg(F.min_by("file_path", "first_seen").alias("primary_path"), F.array_sort(F.collect_set("file_path")).alias("paths"))


def text_of_pages(pages: DataFrame) -> DataFrame:
    """document_id, text: texts of pages that didn't fail, in order, with an empty line between."""
    rows = pages.filter("status <> 'failed'").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_p"))
    return rows.select("document_id", F.array_join(F.filter(F.transform("_p", lambda p: F.trim(p["text"])), lambda t: t != ""), "\n\n").alias("text"))


def status(documents: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """document_id, indexed_pages, open_jobs, status: indexing while a job is pending or processing."""
    done = pages.groupBy("document_id").agg(F.count_if(F.col("status") != "failed").alias("indexed_pages"))
    open_ = jobs.groupBy("document_id").agg(F.count_if(F.col("status").isin("pending", "processing")).alias("open_jobs"))
    return documents.select("document_id").join(done, "document_id", "left").join(open_, "document_id", "left").na.fill(0).withColumn(
        "status", F.when(F.col("open_jobs") > 0, "indexing").otherwise("done"))


def ancestors(folders: DataFrame) -> DataFrame:
    """folder_id, ancestor_id, distance for trees of any depth up to the session's limit for recursion (100 levels unless
    set otherwise), beyond which the query fails; a folder is its own ancestor at 0."""
    return folders.sparkSession.sql("""WITH RECURSIVE up(folder_id, ancestor_id, distance) AS (
        SELECT folder_id, folder_id, 0 FROM {tree} UNION ALL
        SELECT up.folder_id, tree.parent_id, up.distance + 1 FROM up JOIN {tree} AS tree ON up.ancestor_id = tree.folder_id WHERE tree.parent_id IS NOT NULL)
        SELECT folder_id, ancestor_id, distance FROM up""", tree=folders.select("folder_id", "parent_id"))


def folder_counts(assigned: DataFrame, folders: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """folder_id, n: each document once in every folder that it is in, ancestors included; and all of `documents`, in a
    folder or not, in all-files."""
    each = assigned.join(ancestors(folders), "folder_id").select("doc_id", "ancestor_id").distinct().groupBy(
        F.col("ancestor_id").alias("folder_id")).agg(F.count(F.lit(1)).alias("n"))
    if documents is None:
        return each
    return each.filter("folder_id <> 'all-files'").union(documents.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all-files"), "n"))


def overridden(assigned: DataFrame, overrides: DataFrame, folders: DataFrame) -> DataFrame:
    """doc_id, folder_id, confidence, source (and is_primary, if there): removals first, each of its own folder only; then
    additions with all ancestors, at confidence 1."""
    known = overrides.join(folders.select("folder_id"), "folder_id", "left_semi")
    marked = ["is_primary"] if "is_primary" in assigned.columns else []
    left = assigned.select("doc_id", "folder_id", "confidence", *marked, "source").join(known.filter("action = 'remove'"), ["doc_id", "folder_id"], "left_anti")
    added = known.filter("action = 'add'").join(ancestors(folders), "folder_id").select(
        "doc_id", F.col("ancestor_id").alias("folder_id"), F.lit(1.0).alias("confidence"),
        *(F.lit(False).alias(m) for m in marked), F.lit("manual").alias("source")).distinct()
    return left.join(added, ["doc_id", "folder_id"], "left_anti").unionByName(added)


def claimable(jobs: DataFrame, n: int = 1, attempts: int = 3) -> DataFrame:
    """The oldest pending jobs with attempts left."""
    return jobs.filter((F.col("status") == "pending") & (F.col("attempts") < attempts)).orderBy("created_at", "page_number", "job_id").limit(n)


def claimed(jobs: DataFrame, n: int = 1, attempts: int = 3) -> DataFrame:
    """jobs after the oldest `n` pending ones are taken: those are processing, with one more attempt. At most `n` ids
    travel."""
    taken = claimable(jobs, n, attempts).select("job_id", F.lit(True).alias("taken"))
    rows = jobs.join(F.broadcast(taken), "job_id", "left")
    mine = F.coalesce("taken", F.lit(False))
    return rows.withColumns({"status": F.when(mine, "processing").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int")}).select(*jobs.columns)


def finished(jobs: DataFrame, results: DataFrame, attempts: int = 3) -> DataFrame:
    """jobs after results (job_id, ok, error) of claimed ones: done jobs go; others are pending again with their error, or
    failed once they had all their attempts."""
    rows = jobs.join(results.select("job_id", "ok", F.col("error").alias("why")), "job_id", "left").filter("ok is null or not ok")
    lost = F.col("ok").isNotNull()
    return rows.withColumns({"status": F.when(lost, F.when(F.col("attempts") >= attempts, "failed").otherwise("pending")).otherwise(F.col("status")),
                             "error": F.when(lost, F.col("why")).otherwise(F.col("error"))}).select(*jobs.columns)


def completed(pages: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """pages with those of the jobs that went well (results: job_id, ok, text): a page replaces one of the same document
    and number."""
    new = jobs.join(results.filter("ok").select("job_id", "text"), "job_id").select("document_id", "page_number", "text", F.lit("done").alias("status"))
    return upserted(pages, new, ["document_id", "page_number"])


def rebuilt(rows: DataFrame, key: str, empty: Column, version: int, known: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows to work out again, rows to keep): all if the stored version is another one, else those where `empty` holds."""
    due = F.lit(known != version) | F.coalesce(empty, F.lit(True))
    return rows.filter(due), rows.filter(~due)


def after_attempt(jobs: DataFrame, results: DataFrame, attempts: int = 3) -> DataFrame:
    """jobs after results (job_id, ok, error): done jobs go, failed ones are pending until their last attempt."""
    rows = jobs.join(results.withColumnRenamed("error", "_error"), "job_id", "left")
    tried = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    state = F.when(F.col("ok").isNull(), F.col("status")).when(tried >= attempts, "failed").otherwise("pending")
    return rows.filter("ok is null or not ok").withColumns({"status": state, "error": F.coalesce("_error", "error"), "attempts": tried}).drop("ok", "_error")


def upserted_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs by document and page: new ones replace old ones but for their creation time; one that is done stays done,
    and a new one that is done isn't taken."""
    keys = ["document_id", "page_number"]
    fresh = new.filter("status is null or status <> 'done'").select(*keys, *(F.col(c).alias(f"_{c}") for c in ("job_id", "status", "attempts", "error", "created_at")), F.lit(True).alias("_new"))
    both = old.join(fresh, keys, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    state = F.when(F.col("status") == "done", "done").when(F.col("_new"), F.coalesce("_status", F.lit("pending"))).otherwise(F.col("status"))
    return both.select(pick("job_id"), *keys, state.alias("status"), F.coalesce(pick("attempts"), F.lit(0)).alias("attempts"), pick("error"),
                       F.coalesce("created_at", "_created_at").alias("created_at"))


def known_by(docs: DataFrame, paths: DataFrame, found: DataFrame) -> DataFrame:
    """found (file_hash, file_path) with document_id: of the document of that content, or else of that path, or else null."""
    by_hash = docs.groupBy("file_hash").agg(F.min("document_id").alias("_h"))
    by_path = paths.groupBy("file_path").agg(F.min("document_id").alias("_p"))
    return found.join(by_hash, "file_hash", "left").join(by_path, "file_path", "left").select("file_hash", "file_path", F.coalesce("_h", "_p").alias("document_id"))

"""Streams: files as they arrive, and the page-job queue in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import store


def arriving(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files that arrive below path, each content once: document_id, file_hash, path, content."""
    rows = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path))
    hashed = rows.withColumn("file_hash", identity.file_hash(F.col("content"))).withWatermark("modificationTime", "30 days")
    return hashed.dropDuplicatesWithinWatermark(["file_hash"]).select(
        identity.document_id(F.col("file_hash")).alias("document_id"), "file_hash", "path", "content")


def drained(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, batch: int = 1000, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Runs a queue to its end: (pages done, jobs left, which are failed). work takes claimed jobs and returns job_id, ok,
    text, error. Each round claims at most `batch` jobs and writes the queue as it is then below path, so no plan grows
    with the rounds, and a run that breaks off can go on from the last state that was written."""
    spark, n = jobs.sparkSession, 0

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    jobs = kept(jobs, "jobs-0")
    pages = None
    while not store.claimable(jobs, 1, attempts).isEmpty():
        n += 1
        before = jobs
        jobs = kept(store.claimed(jobs, batch, attempts), f"claimed-{n}")
        taken = jobs.filter("status = 'processing'").join(before.filter("status = 'processing'").select("job_id"), "job_id", "left_anti")
        results = kept(work(taken), f"results-{n}")
        done = taken.join(results.filter("ok").select("job_id", "text"), "job_id").select("document_id", "page_number", "text", F.lit("done").alias("status"))
        done.write.mode("append").parquet(f"{path}/pages")
        pages = spark.read.schema(done.schema).parquet(f"{path}/pages")
        jobs = kept(store.finished(jobs, results.select("job_id", "ok", "error"), attempts), f"jobs-{n}")
    return pages, jobs


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Beyond the reference: counts of events by kind in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n")

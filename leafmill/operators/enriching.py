"""Enrichment by models as a job that can go on where it broke off, and measures of what its stages did.

Outputs are kept at a path in batches: one Parquet folder each, listed by a numbered version. A row of them names the
document, the fingerprint of the text that it was made of, and the output or the error. A run takes the documents whose
text has no output yet, BATCH rows or so at a time, and those that failed before in batches of their own, up to
`attempts` times; a batch counts once its version is there, so a run that breaks off loses the batch that it was in.

Cases: null texts are empty texts; rows that repeat an id with one text are one; a text that changes is due again, and
what was made of the old one doesn't count; an empty table makes no batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from ..sources import versions
from . import models

BATCH = 10_000


def _kept(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """id, mark, output, error, seconds, batch: all that is kept."""
    schema = f"id string, mark string, output {kind}, error string, seconds double"
    out = spark.createDataFrame([], schema + ", batch int")
    for i, folder in enumerate(versions.got(spark, path)[1].get("batches", [])):
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/{folder}").withColumn("batch", F.lit(i)))
    return out


def outputs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """id, mark, output, error, tries: the last of each document and text."""
    rows = _kept(spark, path, kind).groupBy("id", "mark").agg(F.max_by(F.struct("output", "error"), "batch").alias("r"), F.count(F.lit(1)).alias("tries"))
    return rows.select("id", "mark", "r.*", "tries")


def due(docs: DataFrame, path: str, kind: str, attempts: int = 3, key: str = "document_id", text: str = "text") -> DataFrame:
    """id, mark, text, again: documents without an output of their text; again if it failed before."""
    given = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), fingerprint(F.col(text)).alias("mark"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["id", "mark"])
    done = outputs(docs.sparkSession, path, kind).select("id", "mark", F.col("error").isNotNull().alias("_failed"), "tries")
    rows = given.join(done, ["id", "mark"], "left").filter(F.col("_failed").isNull() | F.col("_failed") & (F.col("tries") < attempts))
    return rows.select("id", "mark", "text", F.coalesce("_failed", F.lit(False)).alias("again"))


def enriched(docs: DataFrame, path: str, name: str, make: Callable[[], object], apply: Callable[[object, str], object], kind: str, batch: int = BATCH, attempts: int = 3,
             key: str = "document_id", text: str = "text", measures: Measures | None = None) -> DataFrame:
    """outputs() after a run over all that is due. What make() raises ends the run; what apply() raises is its row's error."""
    spark = docs.sparkSession
    todo = due(docs, path, kind, attempts, key, text)
    for again in (False, True):
        rows = todo.filter(F.col("again") == again)
        n = max(1, -(-rows.count() // batch))
        for i in range(n):
            own = due(docs, path, kind, attempts, key, text).filter((F.col("again") == again) & (F.pmod(F.xxhash64("id"), F.lit(n)) == i))
            if again:  # what failed in this run waits for the next one
                own = own.join(todo.filter("again").select("id", "mark"), ["id", "mark"], "left_semi")
            made = models.by_model(own.drop("again"), name, make, apply, kind, seconds="seconds").select("id", "mark", "output", "error", "seconds")
            if measures is not None:
                made = measures.of(f"{name}-{'again-' if again else ''}{i}", made, F.col("error"), F.col("seconds"))
            folder = f"batch-{uuid.uuid4().hex}"
            made.write.parquet(f"{path}/{folder}")
            version, state = versions.got(spark, path)
            if spark.read.parquet(f"{path}/{folder}").isEmpty():
                versions.dropped(spark, f"{path}/{folder}")
            else:
                versions.put(spark, path, version + 1, {"batches": [*state.get("batches", []), folder]})
    return outputs(spark, path, kind)


class Measures:
    """Rows, errors and seconds of stages, taken while they run: no stage is run again for them."""

    def __init__(self, libraries: dict[str, str] | None = None):
        self.libraries, self.stages = libraries or {}, {}

    def of(self, name: str, df: DataFrame, error: Column | None = None, seconds: Column | None = None) -> DataFrame:
        """df, observed as the stage `name`. Its measures are there once df has been written or collected."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self.stages[name] = seen
        error, seconds = F.lit(None) if error is None else error, F.lit(None).cast("double") if seconds is None else seconds
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(error.isNotNull()).alias("errors"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"))

    def report(self, spark: SparkSession) -> DataFrame:
        """stage, rows, errors, seconds of all stages, which must have run; and the capabilities as rows of 0 or 1."""
        rows = [(name, seen.get["rows"], seen.get["errors"], float(seen.get["seconds"])) for name, seen in self.stages.items()]
        rows += [(f"has {what}", int(there), 0, 0.0) for what, there in models.capabilities(self.libraries).items()]
        return spark.createDataFrame(rows, "stage string, rows long, errors long, seconds double")

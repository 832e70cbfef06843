"""Numbered versions of something stored in a folder, of which each number can be taken once; and where to store what
steps share."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Seconds after which a version that was taken and not made may be taken again.
STALE = 600


class Taken(RuntimeError):
    """Another writer has made the version that this one was about to make. What it read is out of date: read and try again."""


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local one, with a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.gettempdir() + "/checkpoints"
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df with its rows dealt out anew if it has fewer partitions than there are cores: a file of one row group would
    keep all but one of them idle. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _at(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    own, files = _at(spark, f"{path}/versions/*.json")
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in files.globStatus(own) or [])


def put(spark: SparkSession, path: str, version: int, what: dict) -> None:
    """Makes a version: its file is written under another name and then moved to its own, which fails if that is there.
    Readers see all of it or nothing, and of two writers one gets Taken."""
    draft, files = _at(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    own, _ = _at(spark, f"{path}/versions/{version}.json")
    lock, _ = _at(spark, f"{path}/versions/{version}.taken")
    files.mkdirs(own.getParent())
    if not files.createNewFile(lock):  # atomic where the store can say so
        # a writer that died between its two steps holds the number for a while only
        if files.exists(own) or files.getFileStatus(lock).getModificationTime() > 1000 * (time.time() - STALE):
            raise Taken(f"version {version} of {path} is there")
    out = files.create(draft, False)
    out.write(json.dumps(what).encode())
    out.close()
    if not files.rename(draft, own):
        raise Taken(f"version {version} of {path} is there")


def got(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """The last version, or the one of that number; 0 and nothing if there is none."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if not version:
        return 0, {}
    return version, json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/versions/{version}.json").collect()))


def dropped(spark: SparkSession, path: str) -> None:
    own, files = _at(spark, path)
    files.delete(own, True)


def source_mark(df: DataFrame) -> str:
    """A name for the files that df reads: another one as soon as one of them is another file."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        own, files = _at(spark, name)
        f = files.getFileStatus(own)
        out.append(f"{name} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(out).encode()).hexdigest()

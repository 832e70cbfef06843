"""A stored library that changes without being written again: tables with change logs, merged when they are read.

A change is a set of rows to add or replace and of keys to delete, for one table or several. It is written as small log
folders, and counts once the next numbered version lists them: readers see all of it or nothing, and of two writers that
began from one version the second gets versions.Taken. A table is its base, less the keys in its log, and the log's last
row of each key. compacted() makes a new base of that; it costs what a full write costs, so it is for now and then.

Cases: rows that repeat a key in one change count once, the one of greatest JSON text; a key that is both added and
deleted in one change is there; null key columns are keys like any other; a change without rows makes no version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema, versions


def _key(name: str) -> Column:
    return F.to_json(F.struct(*schema.KEYS[name])).alias("_key")


class Library:
    """One version of the library at `path`."""

    def __init__(self, spark: SparkSession, path: str, version: int, state: dict):
        self.spark, self.path, self.version = spark, path, version
        self.state = state or {"tables": {}, "marks": {}, "last": 0}

    def _log(self, name: str) -> DataFrame:
        """_key, _there, row: the last entry of every key in the table's log. Which one is the last is told by keys alone."""
        kind = schema.schema(name)
        out, log = None, self.state["tables"].get(name, {}).get("log", [])
        for number, folder in log:
            rows = self.spark.read.schema(f"_key string, _there boolean, row struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in kind)}>").parquet(f"{self.path}/{folder}")
            rows = rows.withColumn("_n", F.lit(number))
            out = rows if out is None else out.unionByName(rows)
        if len(log) > 1:
            out = out.join(out.groupBy("_key").agg(F.max("_n").alias("_n")), ["_key", "_n"])
        return out if out is None else out.select("_key", "_there", "row")

    def table(self, name: str) -> DataFrame:
        base = self.state["tables"].get(name, {}).get("base")
        rows = schema.conformed(self.spark.read.parquet(f"{self.path}/{base}"), name) if base else schema.empty(self.spark, name)
        log = self._log(name)
        if log is None:
            return rows
        left = rows.withColumn("_key", _key(name)).join(log.select("_key"), "_key", "left_anti").drop("_key") if base else rows
        return left.unionByName(log.filter("_there").select("row.*"))

    def keys_since(self, name: str, number: int) -> DataFrame | None:
        """The keys of a table that changes after that number name; None if its log was merged since."""
        own = self.state["tables"].get(name, {"log": []})
        if own.get("from", 0) > number:
            return None
        kind = schema.schema(name)
        fields = ", ".join(f"{k} {kind[k].dataType.simpleString()}" for k in schema.KEYS[name])
        out = self.spark.createDataFrame([], "_key string")
        for n, folder in own["log"]:
            if n > number:
                out = out.union(self.spark.read.schema("_key string").parquet(f"{self.path}/{folder}"))
        return out.distinct().select(F.from_json("_key", fields).alias("k")).select("k.*")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in schema.TABLES}

    def changed(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], mark: tuple[str, str] | None = None) -> Library:
        """The library after changes: table to (rows to add or replace, rows whose keys are to go). mark: a name and what it
        last did, kept with the version."""
        tables = {name: dict(t) for name, t in self.state["tables"].items()}
        number, any_rows, drafts = self.state["last"] + 1, False, f"{self.path}/draft-{uuid.uuid4().hex}"
        for name, (new, gone) in changes.items():
            made = None
            if new is not None:
                own = schema.conformed(new, name)
                row = F.struct(*own.columns)
                made = self._single(own.select(_key(name), F.lit(True).alias("_there"), row.alias("row")), drafts)
            if gone is not None:
                keys = gone.select(_key(name), F.lit(False).alias("_there")).distinct()
                keys = keys if made is None else keys.join(made.select("_key"), "_key", "left_anti")
                made = keys if made is None else made.unionByName(keys, allowMissingColumns=True)
            if made is None:
                continue
            folder = f"log-{uuid.uuid4().hex}"
            kind = schema.schema(name)
            made.select("_key", "_there", F.col("row").cast(kind) if "row" in made.columns else F.lit(None).cast(kind).alias("row")).write.parquet(f"{self.path}/{folder}")
            if self.spark.read.parquet(f"{self.path}/{folder}").isEmpty():
                versions.dropped(self.spark, f"{self.path}/{folder}")
                continue
            any_rows = True
            own = tables.setdefault(name, {"base": None, "log": []})
            own["log"] = [*own["log"], [number, folder]]
        versions.dropped(self.spark, drafts)
        if not any_rows and (mark is None or self.state["marks"].get(mark[0]) == mark[1]):
            return self
        marks = self.state["marks"] | ({mark[0]: mark[1]} if mark else {})
        return self._put({"tables": tables, "marks": marks, "last": number})

    def _single(self, rows: DataFrame, drafts: str) -> DataFrame:
        """rows (_key, _there, row) with each key once. They are written and counted by their keys, so that whole rows meet
        only where a key comes again."""
        at = f"{drafts}/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        made = self.spark.read.schema(rows.schema).parquet(at)
        again = made.groupBy("_key").count().filter("count > 1").select("_key")
        if again.isEmpty():
            return made
        twice = made.join(again, "_key", "left_semi").groupBy("_key", "_there").agg(F.max_by("row", F.to_json("row")).alias("row"))
        return made.join(again, "_key", "left_anti").unionByName(twice)

    def _put(self, state: dict) -> Library:
        versions.put(self.spark, self.path, self.version + 1, state)
        return Library(self.spark, self.path, self.version + 1, state)

    def compacted(self, names: list[str] | None = None) -> Library:
        """The same tables, with their logs made part of new bases."""
        tables = dict(self.state["tables"])
        for name in names or list(tables):
            if tables.get(name, {}).get("log"):
                folder = f"base-{uuid.uuid4().hex}"
                # sorted by key, so that a filter on few keys reads few row groups
                keys = schema.KEYS[name]
                self.table(name).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/{folder}")
                tables[name] = {"base": folder, "log": [], "from": self.state["last"]}
        return self if tables == self.state["tables"] else self._put(self.state | {"tables": tables})

    def cleaned(self) -> None:
        """Drops what earlier versions have and this one doesn't. To be called when none of those is being read."""
        of = lambda state: {f for t in state["tables"].values() for f in (t["base"], *(x for _, x in t["log"])) if f}
        kept = of(self.state)
        for v in versions.versions(self.spark, self.path):
            if v < self.version:
                for folder in of(versions.got(self.spark, self.path, v)[1]) - kept:
                    versions.dropped(self.spark, f"{self.path}/{folder}")


def opened(spark: SparkSession, path: str) -> Library:
    """The library at path as it is now; an empty one where there is none."""
    return Library(spark, path, *versions.got(spark, path))

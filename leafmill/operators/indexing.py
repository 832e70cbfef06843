"""A kept full-text index: segments on disk, changed by small new segments, and merged now and then.

A segment holds postings (token, doc_id, tf, doc_len), dealt into `buckets` folders by the token's hash and sorted by
token in each; the length of each of its documents; its different words, with the forms by which near words are found;
and the ids of the documents that it puts out of force in all earlier segments. A document that is
added, replaced or deleted makes a new segment of its own rows: nothing that is there is written again until segments
are merged. The list of segments is a numbered version; two writers can't take one number, and readers see a change
whole or not at all.

A search reads the buckets of its words only, and the ids out of force. The numbers of documents and words of the whole
index are kept with the version.

Cases: null and empty texts are documents without words; of rows that repeat a doc_id in one change, one counts, the
greatest in text; rows without a doc_id are left out; to delete what isn't there changes nothing; empty changes make no
version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from . import fuzzy, search

#: Part of the name of an index that kept() makes.
FORMAT = 1
POSTINGS = "token string, doc_id long, tf long, doc_len int, bucket int"
FORMS = "form string, token string, bucket int"
#: So many ids out of force may travel: some tens of megabytes.
GONE = 2_000_000


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _joined(spark: SparkSession, path: str, segments: list[dict], part: str, schema: str) -> DataFrame:
    """Rows of a part of all segments, with the segment's number."""
    out = spark.createDataFrame([], schema + ", segment int")
    for s in segments:
        own = spark.read.schema(schema).parquet(f"{path}/{s['name']}/{part}")
        out = out.unionByName(own.withColumn("segment", F.lit(s["number"])))
    return out


class Index:
    """One version of the index at `path`; read anew by opened()."""

    def __init__(self, spark: SparkSession, path: str, version: int, state: dict):
        self.spark, self.path, self.version = spark, path, version
        self.segments = state.get("segments", [])
        self.docs, self.words, self.buckets, self.last = (state.get(k, d) for k, d in (("docs", 0), ("words", 0), ("buckets", 32), ("last", 0)))

    def _in_force(self, part: str, schema: str, some=lambda rows: rows) -> DataFrame:
        """Rows (`some` of them) of a part of all segments, without those of documents that a later segment puts out of
        force. Rows of segments that come after all of these are not looked at, and a few ids travel to the others."""
        gone = [s for s in self.segments if s["gone"]]
        last = max((s["number"] for s in gone), default=0)
        read = lambda segments: some(_joined(self.spark, self.path, segments, part, schema))
        later = read([s for s in self.segments if s["number"] >= last])
        if not gone:
            return later
        ids = _joined(self.spark, self.path, gone, "gone", "doc_id long").groupBy("doc_id").agg(F.max("segment").alias("_last"))
        if sum(s.get("n_gone", GONE) for s in gone) < GONE:
            ids = F.broadcast(ids)
        rows = read([s for s in self.segments if s["number"] < last])
        return rows.join(ids, "doc_id", "left").filter(F.col("_last").isNull() | (F.col("segment") >= F.col("_last"))).drop("_last").unionByName(later)

    def sizes(self) -> DataFrame:
        """doc_id, doc_len of every document."""
        return self._in_force("sizes", "doc_id long, doc_len int").select("doc_id", "doc_len")

    def _with(self, key: str, keys: list[str]):
        """Picks rows with one of the keys. Only the keys' buckets are read."""
        buckets = self.spark.range(1).select(F.array(*(_bucket(F.lit(k), self.buckets) for k in keys)).alias("b")).head()["b"] if keys else []
        return lambda rows: rows.filter(F.col("bucket").isin(sorted(set(buckets))) & F.col(key).isin(keys))

    def _of(self, part: str, schema: str, key: str, keys: list[str]) -> DataFrame:
        """Rows of all segments with one of the keys."""
        return self._with(key, keys)(_joined(self.spark, self.path, self.segments, part, schema))

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """token, doc_id, tf, doc_len of these tokens, or of all."""
        some = (lambda rows: rows) if tokens is None else self._with("token", tokens)
        return self._in_force("postings", POSTINGS, some).select("token", "doc_id", "tf", "doc_len")

    def close(self, token: str, recognised: bool = False) -> DataFrame:
        """token: the words in any segment that are nearly `token`, itself too; each is compared once."""
        words = _joined(self.spark, self.path, self.segments, "words", "token string, n int")
        forms = self._of("forms", FORMS, "form", fuzzy.own_forms(token)) if fuzzy.by_forms(token, recognised) else None
        return fuzzy.close(words, forms, token, recognised)

    def near(self, token: str, recognised: bool = False) -> DataFrame:
        """doc_id: documents with a word that is nearly `token`."""
        words = [r["token"] for r in self.close(token, recognised).limit(search.NEAR + 1).collect()]
        if len(words) > search.NEAR:  # too many to name
            rows = self._in_force("postings", POSTINGS, lambda rows: rows.join(self.close(token, recognised), "token", "left_semi"))
            return rows.select("doc_id").distinct()
        return self.postings(words).select("doc_id").distinct()

    def bm25(self, query: str, limit: int = 100, k1: float = 1.2, b: float = 0.75, most: int = 8) -> DataFrame:
        """As search.bm25()."""
        asked = search.query_tokens(query)[:most]
        stats = self.spark.range(1).select(F.lit(self.docs).alias("docs"), F.lit(self.words / max(1, self.docs)).alias("mean"))
        return search.bm25_ranked(self.postings(asked), stats, asked, limit, k1, b)

    # --- changes ---

    def changed(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, text: str = "text") -> Index:
        """The index with documents (doc_id and text) added or replaced, and the ids of `deletes` (doc_id) gone."""
        spark, number, name = self.spark, self.last + 1, f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        new = spark.createDataFrame([], "doc_id long, text string") if upserts is None else upserts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        new = new.filter("doc_id IS NOT NULL")
        if not new.groupBy("doc_id").count().filter("count > 1").isEmpty():  # else texts need not move
            new = new.groupBy("doc_id").agg(F.max("text").alias("text"))
        old = spark.createDataFrame([], "doc_id long") if deletes is None else deletes.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
        cut = new.select("doc_id", search.split_words(F.col("text")).alias("w"))
        # ids that were there before, with their lengths: they go out of force
        sizes = cut.select("doc_id", F.size("w").alias("doc_len"))
        sizes.write.parquet(f"{at}/sizes")
        sizes = spark.read.schema("doc_id long, doc_len int").parquet(f"{at}/sizes")
        touched = sizes.select("doc_id").union(old).distinct()
        gone = self.sizes().join(touched, "doc_id", "left_semi") if self.segments else spark.createDataFrame([], "doc_id long, doc_len int")
        gone.write.parquet(f"{at}/gone")
        left = spark.read.schema("doc_id long, doc_len int").parquet(f"{at}/gone").agg(F.count(F.lit(1)), F.sum("doc_len")).head()
        came = sizes.agg(F.count(F.lit(1)), F.sum("doc_len")).head()
        if not came[0] and not left[0]:
            versions.dropped(spark, at)
            return self
        rows = search.counted(cut.select("doc_id", F.size("w").alias("doc_len"), "w"), ["doc_id", "doc_len"], F.col("w")).select("token", "doc_id", "tf", "doc_len")
        self._written(rows, at)
        state = {"segments": [*self.segments, {"name": name, "number": number, "gone": bool(left[0]), "n_gone": left[0]}], "docs": self.docs + came[0] - left[0],
                 "words": self.words + (came[1] or 0) - (left[1] or 0), "buckets": self.buckets, "last": number}
        versions.put(spark, self.path, self.version + 1, state)
        return Index(spark, self.path, self.version + 1, state)

    def _written(self, rows: DataFrame, at: str) -> None:
        """Postings and dictionary of a new segment. Hot tokens are dealt over tasks by document, so none is one task's alone."""
        dealt = rows.withColumn("bucket", _bucket(F.col("token"), self.buckets)).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        dealt.sortWithinPartitions("bucket", "token", "doc_id").write.partitionBy("bucket").parquet(f"{at}/postings")
        own = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").select("token").distinct().withColumn("n", F.length("token"))
        own.repartitionByRange("n", "token").sortWithinPartitions("n").write.parquet(f"{at}/words")
        own = self.spark.read.schema("token string, n int").parquet(f"{at}/words")
        forms = own.select(F.explode(fuzzy.forms(F.col("token"))).alias("form"), "token").withColumn("bucket", _bucket(F.col("form"), self.buckets))
        forms.repartition("bucket").sortWithinPartitions("bucket", "form").write.partitionBy("bucket").parquet(f"{at}/forms")

    def merged(self) -> Index:
        """All segments as one, without what is out of force. Searches of earlier versions go on until cleaned()."""
        if len(self.segments) < 2 and not any(s["gone"] for s in self.segments):
            return self
        name = f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        self.sizes().write.parquet(f"{at}/sizes")
        self.spark.createDataFrame([], "doc_id long, doc_len int").write.parquet(f"{at}/gone")
        self._written(self.postings(), at)
        state = {"segments": [{"name": name, "number": self.last + 1, "gone": False}], "docs": self.docs, "words": self.words, "buckets": self.buckets, "last": self.last + 1}
        versions.put(self.spark, self.path, self.version + 1, state)
        return Index(self.spark, self.path, self.version + 1, state)

    def cleaned(self) -> None:
        """Drops segments that this version doesn't have. To be called when no earlier one is being read."""
        kept = {s["name"] for s in self.segments}
        for v in versions.versions(self.spark, self.path):
            if v < self.version:
                for s in versions.got(self.spark, self.path, v)[1]["segments"]:
                    if s["name"] not in kept:
                        versions.dropped(self.spark, f"{self.path}/{s['name']}")


def opened(spark: SparkSession, path: str, buckets: int = 32) -> Index:
    """The index at path as it is now; an empty one where there is none."""
    version, state = versions.got(spark, path)
    return Index(spark, path, version, state or {"buckets": buckets})


def kept(docs: DataFrame, text: str = "text", buckets: int = 32) -> Index:
    """The index of the files that docs reads: made once in the shared folder, and found again as long as the files are the same."""
    spark = docs.sparkSession
    path = f"{versions.shared(spark)}/index-{FORMAT}-{versions.source_mark(docs)}-{text}"
    index = opened(spark, path, buckets)
    if index.version:
        return index
    try:
        return index.changed(docs, text=text)
    except versions.Taken:  # another session was faster
        return opened(spark, path, buckets)

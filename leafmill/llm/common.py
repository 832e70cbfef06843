"""What several operators share: shared storage, copies of a text, components, and arithmetic on bytes.

Tables that more than one step reads are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``; every executor can read them again after another one is lost.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.gettempdir() + "/checkpoints"
    return found.rstrip("/")


#: Tables and folders that calls within made() have written so far; None outside.
_SCOPE: ContextVar[list[tuple[str, str]] | None] = ContextVar("made", default=None)


@contextmanager
def made() -> Iterator[list[tuple[str, str]]]:
    """Collects what the calls inside write for steps in between, for cleared(). What others write isn't in it."""
    own: list[tuple[str, str]] = []
    before = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(before)


def _noted(spark: SparkSession, kind: str, name: str) -> None:
    own = _SCOPE.get()
    if own is not None:
        own.append((kind, name))


def cleared(spark: SparkSession, own: list[tuple[str, str]], keep: DataFrame | None = None) -> None:
    """Drops the tables and folders of a made(), but those that `keep` reads, which stay in the list. To be called once
    the results that need them are written elsewhere."""
    needed = " ".join(keep.inputFiles()) if keep is not None else ""
    held = []
    for kind, name in own:
        folder = name if kind == "folder" else f"{shared_dir(spark)}/{name}"
        if folder.rsplit("/", 1)[-1] in needed:
            held.append((kind, name))
            continue
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    own[:] = held


def whole_rows(df: DataFrame) -> Column:
    """All columns of df as one named `row`: whatever they are called, no helper column can clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _noted(spark, "folder", path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession) -> None:
    """Batches of texts that go to Python hold a few megabytes, however long the texts are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def given_back() -> None:
    """A Python worker lives on after its task; what it no longer uses goes back to the machine."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def swept(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected its garbage; large ones shouldn't wait."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


#: A text with more than one row in HOT is a hot one. At most HOT texts can be.
HOT = 1000


def copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, rep, n_copies) for every row: rows of equal text share digest and rep, the smallest doc_id.

    Only digests move; the sums are made before the shuffle, and rows of texts with many copies don't move for the join,
    so one text in a third of all rows is no hot spot.
    A row without doc_id counts as one with the smallest id there is.
    """
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).select(
        "doc_id", F.unhex(F.sha2(F.col("_t"), 256)).alias("digest"), F.octet_length("_t").cast("long").alias("n_bytes"))
    own = stored(own, "digests")
    each = own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    hot = stored(each.filter(F.col("n_copies") * HOT > own.count()), "frequent")
    # texts of many copies: fewer than HOT rows, which travel to every task; so none of their copies moves
    rest = own.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(each, "digest")
    return own.join(F.broadcast(hot), "digest").unionByName(rest)


def met(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the facts of their key, of which there is one row each; its column `n` says in how many rows the key is.
    Keys of more than one row in HOT are fewer than HOT: their facts travel, and their rows stay where they are."""
    total = facts.agg(F.sum(n)).head()[0] or 0
    hot = stored(facts.filter(F.col(n) * HOT > total), "hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def with_facts(own: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of copies() with the facts (digest and more, one row for each text) of their text. Texts of more than one
    row in HOT are fewer than HOT; their facts travel, and their rows stay."""
    many = F.col("n_copies") * HOT > own.count()
    few = facts.join(F.broadcast(own.filter(many).select("digest").distinct()), "digest", "left_semi")
    return own.filter(many).join(F.broadcast(few), "digest").unionByName(own.filter(~many).join(facts, "digest"))


#: Bytes of text that a block, the unit of work in Python, and a part, the unit on disk, should have.
BLOCK, PART = 6 << 20, 32 << 20


def blocks(docs: DataFrame, own: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(block, doc_id, digest, data: the text's bytes), one row for each different text of docs, whose copies() are own;
    and their number of bytes. The table is bucketed by block: the texts move once, dealt by doc_id, and stay.

    Both sides of the semi-join are dealt by block, which is part of its key, so the join itself moves nothing.
    """
    spark = docs.sparkSession
    lean(spark)
    total = own.agg(F.sum("n_bytes")).head()[0] or 0
    n_blocks = max(2 * cores(spark), -(-total // BLOCK))
    parts = max(2 * cores(spark), -(-total // PART))
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(n_blocks)).cast("int").alias("block")
    plain = F.coalesce(F.col(text), F.lit(""))
    left = docs.select(block, "doc_id", F.unhex(F.sha2(plain, 256)).alias("digest"), plain.cast("binary").alias("data"))
    right = own.select(F.col("rep").alias("doc_id"), "digest").distinct().select(block, "doc_id", "digest")
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        left, right = left.repartition(parts, "block"), right.repartition(parts, "block")
        same = (left["block"] == right["block"]) & left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"])
        kept = left.join(right.hint("shuffle_hash"), same, "left_semi")
        name = f"texts_{uuid.uuid4().hex}"
        _noted(spark, "table", name)
        (kept.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
             .bucketBy(parts, "block").format("parquet").saveAsTable(name))
    finally:
        spark.conf.set(key, before)
    del left, right, kept
    swept(spark)
    return spark.table(name), total


def shrunk(keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the bytes of their steps, lowest bytes first: the higher ones hardly differ, and the
    shuffle's own compression takes them away."""
    return np.diff(keys.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def grown(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def coded(keys: np.ndarray) -> bytes:
    return shrunk(keys) if keys.dtype.itemsize == 4 else keys.tobytes()


def decoded(data: bytes, dtype: str) -> np.ndarray:
    return grown(data) if dtype == "<u4" else np.frombuffer(data, dtype=dtype)


def sent(keys: np.ndarray, bucket: np.ndarray, block: int, extra: np.ndarray | None = None) -> list[tuple]:
    """Rows (bucket, block, keys and more) of one block: each key once, or twice if the block has it more often."""
    order = np.lexsort((keys, bucket))
    keys, bucket = keys[order], bucket[order]
    if len(keys) > 2:
        third = np.zeros(len(keys), dtype=bool)
        third[2:] = (keys[2:] == keys[:-2]) & (bucket[2:] == bucket[:-2])
        keys, bucket = keys[~third], bucket[~third]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return [(int(bucket[a]), block, coded(keys[a:b])) for a, b in zip(cut, [*cut[1:], len(keys)])]


def tied(rows: DataFrame, dtype: str) -> DataFrame:
    """(block, bucket, keys): of the rows of sent(), the keys that two texts or places have. One bucket is sorted at a
    time; a key that a third of all texts have is in a bucket at most twice for each block."""

    def run(pdf):
        arrays = [decoded(x, dtype) for x in pdf["keys"]]
        every = np.sort(np.concatenate(arrays))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for block, own in zip(pdf["block"], arrays):
            hit = np.unique(own[member(own, twice)])
            if len(hit):
                out.append((block, pdf["bucket"].iloc[0], coded(hit)))
        del arrays, every, twice
        given_back()
        return pd.DataFrame(out, columns=["block", "bucket", "keys"])

    return rows.groupBy("bucket").applyInPandas(run, "block int, bucket int, keys binary")


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over the rows (a, b) of edges.

    Alternates large-star and small-star steps; every step moves at most one row for each edge, so a node with many
    links stays one row for each link. It ends when a round changes nothing, which takes about as many rounds as the
    logarithm of the longest chain, and only a count and a sum reach the driver.
    """
    now = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    last = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        small_in = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small_in.groupBy("a").agg(F.min("b").alias("m"))
        joined = small_in.join(least, "a")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(sums) == last:
            break
        last = tuple(sums)
    roots = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()).groupBy("node").agg(
        F.min("component").alias("component"))


# --- bytes ------------------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15 | 1
#: Sums of bytes are taken modulo a prime, in two lanes of bases and codes of their own. Modulo a power of two, some
#: strings (Thue-Morse words) would have equal sums for every base.
PRIME = U64((1 << 31) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64; kept for a power of two, so that few lengths are ever made."""
    return _powers(1 << max(16, (n - 1).bit_length()), base)[:n]


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or that and the prime, for x below 2 ** 62; in place."""
    high = x >> U64(31)
    x &= PRIME
    x += high
    return x


_PRIME_POWERS: dict[int, np.ndarray] = {}


def _prime_powers(n: int, base: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo the prime; what is there is kept, and doubled where it is too short."""
    out = _PRIME_POWERS.get(base, np.ones(1, dtype=U64))
    while len(out) < n:
        x = reduced(reduced(out * U64(pow(base, len(out), int(PRIME)))))
        out = _PRIME_POWERS[base] = np.concatenate([out, np.where(x >= PRIME, x - PRIME, x)])
    return out[:n]


def _lanes() -> list[tuple[int, int, np.ndarray]]:
    rnd = np.random.default_rng(20)
    out = []
    for _ in range(2):
        base = int(rnd.integers(1 << 20, int(PRIME) - 1))
        out.append((base, pow(base, -1, int(PRIME)), rnd.choice(int(PRIME) - 1, 256, replace=False).astype(U64) + U64(1)))
    return out


LANES = _lanes()


class Prefixes:
    """Hashes of any substring of a run of bytes, from running sums of code * base ** position modulo a prime.

    Two different strings of n bytes have one hash with a chance of about (n / 2 ** 31) ** 2 over the random bases, and
    of 2 ** -62 where they are unrelated.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.lanes = []
        for base, inverse, codes in LANES:
            weight = _prime_powers(n, base)
            sums = np.zeros(n + 1, dtype=U64)
            for a in range(0, n, 1 << 16):  # what a core's own memory holds
                b = min(n, a + (1 << 16))
                x = codes[data[a:b]]
                x *= weight[a:b]
                np.cumsum(reduced(x), out=sums[a + 1:b + 1])  # below 2 ** 33 bytes this can't overflow
                sums[a + 1:b + 1] += sums[a]
            self.lanes.append((sums, _prime_powers(n + 1, inverse)))

    @staticmethod
    def _name(parts: list[np.ndarray]) -> np.ndarray:
        a, b = (np.where(x >= PRIME, x - PRIME, x) for x in (reduced(x) for x in parts))
        return mixed(a | b << U64(31))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._name([reduced(reduced(reduced(s[end] - s[start])) * back[start]) for s, back in self.lanes])


def chunked(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `limit` bytes, or of one longer text."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)

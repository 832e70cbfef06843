"""Ranked lexical search over inverted treaps.

Documents are read once; what a term's postings hold is found in tasks, some hundred documents at a time, and only of
terms that some item may ask for: a field of bits of fixed size, set by the items' terms, lets the others go before
anything is written, and a join with the items' terms drops those that share a bit. Counts, lengths and frequencies take
in every document.

Postings are dealt by documents into shards. There each term has a treap over its postings: in search order of the
document's place, in heap order of its impact, the integer that the term's weight is multiplied by. All treaps of a
shard are built in one flat array: a posting's parent is the weaker of the nearest stronger ones at its two sides.

A search walks the treaps of an item's terms at once, over intervals of documents, the most promising ones first. Of an
interval each term has the root of its subtree there, so the weighted sum of the roots' impacts bounds every score in it;
an interval below the k best scores so far goes with all its subtrees. Else its strongest posting's document is scored,
the interval falls into two at it, and each term's root moves down to the subtrees. Intervals of LEAF documents or less
are scored whole. The first of SCOUTS shards are searched before the others, which then begin with the scores of those
k best: that spares work and changes no result, as the k best of some documents are a lower bound.

Items are searched PART at a time; the k best of all shards are merged.

Cases: null and empty texts have no terms, and items without terms no rows; rows that repeat a doc_id are documents of
their own; rows that repeat an item_id are one item with all their terms; documents without an id count, and come first
among equals, and an item without an id is one item; equal scores go by doc_id; other columns are left out; empty tables
give no rows; texts are never cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a shard, shards of which one goes first, items of a part, documents of an interval that is scored whole.
SHARD, SCOUTS, PART, LEAF = 8192, 8, 256, 64
#: Intervals that are looked at together.
STEP = 64
#: Bits of the field by which terms that nobody asks for are told; 2 MB.
FIELD = 1 << 24
#: The ranking's scale, saturation and length share.
UNIT, FLAT, STEEP, LENGTH = 1_000_000_000, 1000, 12, 25
#: A document without an id.
NOBODY = -(1 << 63)

#: A term is a run of ASCII letters, digits and bytes of other characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def asked(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times) of all items."""

    def run(batches):
        for pdf in batches:
            own = [(i, t, n) for i, x in zip(pdf["item_id"], pdf["text"]) for t, n in Counter(terms(x)).items()]
            yield pd.DataFrame(own, columns=["item_id", "term", "times"])

    named = items.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"))
    return named.mapInPandas(run, "item_id string, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def field(wanted: DataFrame) -> bytes:
    """FIELD bits: those of the terms' checksums are set. Made in tasks; the driver gets it in pieces of fixed number and size."""
    word, bit = 64, F.pmod(F.crc32("term"), F.lit(FIELD))
    words = wanted.select(F.floor(bit / word).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(word)).cast("int")).alias("b"))
    out = np.zeros(FIELD // word, dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return out.tobytes()


def postings(docs: DataFrame, bits: bytes, text: str = "text") -> DataFrame:
    """For every block of documents a row with null term: places' ids and lengths; and for its terms: places and times."""
    spark = docs.sparkSession
    common.lean(spark)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches):
        there, known = np.unpackbits(np.frombuffer(sent.value, dtype=np.uint8), bitorder="little"), {}
        at = TaskContext.get().partitionId() << 32
        for pdf in batches:
            held: dict[bytes, list[int]] = {}
            sizes = []
            for place, x in enumerate(pdf["_t"]):
                own = terms(x)
                sizes.append(len(own))
                for term, n in Counter(own).items():
                    hit = known.get(term)
                    if hit is None:
                        if len(known) > 300_000:
                            known.clear()
                        hit = known[term] = bool(there[zlib.crc32(term) % FIELD])
                    if hit:
                        held.setdefault(term, []).extend((place, n))
            n = len(held)
            pairs = [np.array(x, dtype=np.int32).reshape(-1, 2) for x in held.values()]
            ids = pdf["doc_id"].fillna(NOBODY).to_numpy(np.int64) if pdf["doc_id"].dtype != object else np.array([NOBODY if x is None or pd.isna(x) else int(x) for x in pdf["doc_id"]], dtype=np.int64)
            yield pd.DataFrame({
                "block": at, "term": [None, *held], "df": [int(np.count_nonzero(sizes)), *map(len, pairs)], "size": [sum(sizes), *[0] * n],
                "a": [ids.tobytes(), *(p[:, 0].tobytes() for p in pairs)], "b": [np.array(sizes, dtype=np.int64).tobytes(), *(p[:, 1].tobytes() for p in pairs)]})
            at += 1

    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("_t"))
    return given.mapInPandas(run, "block long, term binary, df long, size long, a binary, b binary")


class Treaps:
    """The treaps of one shard. A posting is a position in flat arrays, by term and then by document; -1 is none."""

    def __init__(self, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        """Postings in any order: number of the term, place of the document, impact."""
        order = np.lexsort((doc, term))
        self.term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.n_docs, self.key = n_docs, self.term * n_docs + self.doc
        n = len(order)
        # equal impacts in a random but lasting order, or a term of equal impacts would be a list
        strength = np.concatenate([self.impact << 32 | (common.mixed(self.doc.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64), [np.iinfo(np.int64).max]])
        new = np.concatenate([[True], self.term[1:] != self.term[:-1]]) if n else np.zeros(0, dtype=bool)
        before, after = np.where(new, n, np.arange(n) - 1), np.where(np.concatenate([new[1:], [True]]) if n else new, n, np.arange(n) + 1)
        stronger = [self._nearest(before, strength, False), self._nearest(after, strength, True)]
        left_is = strength[stronger[0]] < strength[stronger[1]]
        parent = np.where(left_is, stronger[0], stronger[1])
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        inner = parent < n
        self.root = self.term[~inner], np.flatnonzero(~inner)
        at = np.flatnonzero(inner)
        side = left_is[at]  # its parent lies at its left, so it is a right child
        self.right[parent[at[side]]] = at[side]
        self.left[parent[at[~side]]] = at[~side]
        self.doc, self.impact = np.append(self.doc, n_docs), np.append(self.impact, 0)

    @staticmethod
    def _nearest(at: np.ndarray, strength: np.ndarray, ties: bool) -> np.ndarray:
        """The nearest stronger posting at one side (n if there is none), from the neighbour at that side."""
        at, own = np.append(at, len(at)), strength
        todo = np.arange(len(at) - 1)
        while len(todo):
            weaker = own[at[todo]] <= own[todo] if ties else own[at[todo]] < own[todo]
            todo = todo[weaker]
            at[todo] = at[at[todo]]
        return at[:-1]

    def moved(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of what the subtrees hold of documents from low to before high."""
        out = at.copy()
        todo = np.arange(len(at))
        while len(todo):
            now = out[todo]
            doc = self.doc[now]
            small, large = doc < low[todo], doc >= high[todo]
            off = (small | large) & (now >= 0)
            todo, now, small = todo[off], now[off], small[off]
            out[todo] = np.where(small, self.right[now], self.left[now])
        return out

    def scored(self, low: np.ndarray, high: np.ndarray, own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that hold one of the terms `own` and lie in one of the intervals, which don't overlap."""
        first = np.searchsorted(self.key, (own[None, :] * self.n_docs + low[:, None]).ravel())
        size = np.searchsorted(self.key, (own[None, :] * self.n_docs + high[:, None]).ravel()) - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        wide = high - low
        base = np.cumsum(wide) - wide - low  # where an interval's documents begin in one row of all
        score = np.zeros(int(wide.sum()), dtype=np.int64)
        np.add.at(score, np.repeat(np.repeat(base, len(own)), size) + self.doc[at], self.impact[at] * np.repeat(np.tile(weight, len(low)), size))
        hit = np.flatnonzero(score)
        return hit - np.repeat(base, wide)[hit], score[hit]

    def best(self, own: np.ndarray, weight: np.ndarray, k: int, least: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of highest score (least or more, and above 0), equal ones by id, for terms with weights."""
        number = np.searchsorted(self.root[0], own)
        there = number < len(self.root[0])
        there[there] = self.root[0][number[there]] == own[there]
        own, weight, number = own[there], weight[there], number[there]
        docs, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = max(1, least)
        if not len(own):
            return docs, score
        low, high, roots = np.zeros(1, dtype=np.int64), np.full(1, self.n_docs), self.root[1][number][None, :]
        bound = (self.impact[roots] * weight).sum(axis=1)
        while True:
            live = bound >= least
            if not live.all():
                low, high, roots, bound = low[live], high[live], roots[live], bound[live]
            if not len(low):
                return docs, score
            pick = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
            stay = np.ones(len(bound), dtype=bool)
            stay[pick] = False
            a, z, at = low[pick], high[pick], roots[pick]
            wide = z - a > LEAF
            split = self.doc[at[wide][np.arange(wide.sum()), (self.impact[at[wide]] * weight).argmax(axis=1)]]
            more, gain = self.scored(np.concatenate([a[~wide], split]), np.concatenate([z[~wide], split + 1]), own, weight)
            fine = gain >= least
            docs, score = np.concatenate([docs, more[fine]]), np.concatenate([score, gain[fine]])
            if len(docs) > k:
                order = np.lexsort((ids[docs], -score))[:k]
                docs, score = docs[order], score[order]
                least = max(least, int(score[-1]))
            lows, highs = np.concatenate([a[wide], split + 1]), np.concatenate([split, z[wide]])
            down = np.concatenate([at[wide], at[wide]])
            n = down.shape[1]
            down = self.moved(down.ravel(), np.repeat(lows, n), np.repeat(highs, n)).reshape(-1, n)
            low, high, roots = np.concatenate([low[stay], lows]), np.concatenate([high[stay], highs]), np.concatenate([roots[stay], down])
            bound = np.concatenate([bound[stay], (self.impact[down] * weight).sum(axis=1)])


def _shard(pdf: pd.DataFrame, total: int, length: int, terms_of: dict[bytes, int]) -> tuple[np.ndarray, Treaps]:
    """Ids of a shard's documents, and its treaps."""
    whole = pdf["term"].isna().to_numpy()
    first, ids, sizes, n = {}, [], [], 0
    for block, a, b in zip(pdf["block"][whole], pdf["a"][whole], pdf["b"][whole]):
        first[block] = n
        ids.append(np.frombuffer(a, dtype=np.int64))
        sizes.append(np.frombuffer(b, dtype=np.int64))
        n += len(ids[-1])
    some = pdf[~whole]
    places = [np.frombuffer(a, dtype=np.int32).astype(np.int64) + first[block] for block, a in zip(some["block"], some["a"])]
    times = [np.frombuffer(b, dtype=np.int32) for b in some["b"]]
    number = np.repeat(np.array([terms_of[t] for t in some["term"]], dtype=np.int64), [len(p) for p in places])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
    ids, doc, tf = join(ids), join(places), join(times)
    long = np.array([100 - LENGTH + LENGTH * s * total // length for s in join(sizes).tolist()], dtype=np.int64)  # Python's own integers don't overflow
    return ids, Treaps(max(1, n), number, doc, UNIT * tf // (FLAT * tf + STEEP * long[doc]))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of highest score above 0."""
    spark = docs.sparkSession
    wanted = common.stored(asked(items), "asked")
    index = common.stored(postings(docs, field(wanted.select("term").distinct()), text), "postings")
    blocks = index.filter("term IS NULL")
    total, length, places = blocks.agg(F.sum("df"), F.sum("size"), F.sum(F.octet_length("a") / 8)).head()
    schema = "item_id long, rank int, doc_id long, score long"
    if not total:
        return spark.createDataFrame([], schema)
    shards = max(1, round(places / SHARD))
    frequency = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    n_items = wanted.select("item_id").distinct().count()
    parts = max(1, -(-n_items // PART))
    part = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(""))), F.lit(parts)).cast("int").alias("part")
    queries = common.stored(wanted.join(frequency, "term").select(part, "item_id", "term", (weight * F.col("times")).alias("weight")), "weights")
    asking = queries.groupBy("part", "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    lists = index.join(queries.select("term", "part").distinct(), "term").select(shard, F.col("part").alias("part"), "block", "term", "a", "b")
    lists = lists.unionByName(blocks.select(shard, every(parts, "part"), "block", "term", "a", "b"))

    def run(left, right):
        out = []
        if len(left) and len(right):
            terms_of = {t: i for i, t in enumerate(left["term"].dropna().unique())}
            ids, treaps = _shard(left, total, length, terms_of)
            for item, own, weights, least in zip(right["item_id"], right["terms"], right["weights"], right["least"]):
                there = [i for i, t in enumerate(own) if t in terms_of]
                number = np.array([terms_of[own[i]] for i in there], dtype=np.int64)
                found, score = treaps.best(number, np.array([weights[i] for i in there], dtype=np.int64), k, int(least), ids)
                out += [(item, i, s) for i, s in zip(ids[found].tolist(), score.tolist())]
        return pd.DataFrame(out, columns=["item_id", "doc_id", "score"])

    def searched(which, asks: DataFrame) -> DataFrame:
        key = ["shard", "part"]
        asks = asks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).filter(which)
        return lists.filter(which).groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(run, "item_id string, doc_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    scout = F.col("shard") % SCOUTS == 0
    found = common.stored(searched(scout, asking.withColumn("least", F.lit(0).cast("long"))), "scouted")
    if shards > 1:
        least = best(found).filter(F.col("rank") == k).select("item_id", F.col("score").alias("_s"))
        same = asking["item_id"].eqNullSafe(least["item_id"])
        asks = asking.join(least, same, "left").select(asking["*"], F.coalesce("_s", F.lit(0)).alias("least"))
        found = found.unionByName(common.stored(searched(~scout, asks), "searched"))
    who = F.when(F.col("doc_id") != NOBODY, F.col("doc_id"))
    return best(found).select(F.col("item_id").cast("long").alias("item_id"), F.col("rank").cast("int").alias("rank"), who.alias("doc_id"), "score")

"""Repeated byte strings across a corpus: suffixes sorted in buckets, with long ties resolved by difference-cover ranks.

A suffix counts by its first `length` bytes alone; two that agree on them are tied, and those bytes are repeated.

1. Candidates. Places whose offset in their text is in a perfect difference cover modulo v (q + 1 of v = q*q + q + 1)
   are named by a hash of `length - v + 1` bytes. Any two tied suffixes have, within v - 1 bytes, a common cover place
   whose bytes agree, so a suffix with no tied cover place ahead can't be tied. The others are named by a hash of their
   `length` bytes, and only those of a name that another place has go on. Names are 32 bits in a bucket: they only
   nominate, and what they let through by chance costs time alone.
2. Strings. Candidates that lie one after the other become one string, cut wherever the least hash of 16 bytes in a
   suffix's window changes. Tied suffixes have the same least hash, so it names their bucket; a string of n suffixes
   moves as n + length - 1 bytes, not as n times length. Equal strings are counted before they move on and sorted once.
3. Sorting. One bucket at a time: the cover samples of its strings are ranked by their bytes (pieces of v bytes, whose
   ranks are joined two by two), suffixes are sorted by their first bytes, and those tied there are parted by a
   quicksort that compares each with a pivot in one step: by the ranks of the two at their common cover place, then by
   their last bytes. Nothing is compared byte after byte, so long ties cost no more than short ones.

Only what is tied in step 3, by bytes and ranks of bytes, is removed.

Memory: a bucket has about BUCKET bytes of different strings; a string is at most CUT suffixes long. Strings of one least
hash stay together: they are different repeated texts around the same 16 bytes.

Cases: a null or empty text has no bytes and loses none; texts shorter than `length` lose nothing; equal texts of at
least `length` bytes lose everything; rows that repeat a doc_id give a row each; matches never cross documents; extra
columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

#: Names of a bucket of steps before the sort, 4 bytes each; bytes of different strings in a bucket that is sorted.
KEYS, BUCKET = 2_000_000, 1 << 20
#: Suffixes of one string.
CUT = 4096


@lru_cache(maxsize=8)
def cover(q: int) -> tuple[int, np.ndarray]:
    """v and a perfect difference cover of it, for a prime q: the powers of a cubic field's generator in a plane."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # x**3 = a x**2 + b x + c; the exponents i below v at which x**i has no x**2 term
                e, found = (1, 0, 0), []
                for i in range(v):
                    if e[2] == 0:
                        found.append(i)
                    lo, mid, hi = e
                    e = (hi * c % q, (lo + hi * b) % q, (mid + hi * a) % q)
                if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
                    return v, np.array(found)
    raise ValueError(f"{q} is not prime")


def prime_for(length: int) -> int:
    """The largest cover whose period leaves 45 % of `length` to compare."""
    return max((q for q in (2, 3, 5, 7, 11, 13) if (q * q + q + 1) * 20 <= length * 11), default=0)


# --- one bucket -------------------------------------------------------------------------------------------


def _words(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """n bytes from each place as big-endian numbers, so that their order is that of the bytes. data has 8 more bytes."""
    every = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    out = []
    for k in range(0, n, 8):
        w = every[at + k].astype(U64)
        out.append(w >> U64(8 * (8 - (n - k))) if n - k < 8 else w)
    return out


def dense(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row among all different rows, by the first column first."""
    if len(columns) == 1:
        return np.unique(columns[0], return_inverse=True)[1]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class Sorted:
    """The order of the suffixes of some strings by their first `length` bytes.

    rank[i] is the rank of the i-th suffix; equal ranks are ties. Suffixes are listed string by string; a string of m
    bytes has m - length + 1 of them.
    """

    def __init__(self, strings: list[bytes], length: int):
        q = 3 if length >= 25 else 2
        self.v, places = cover(q)
        v = self.v
        self.length = length
        self.window = (length - v + 1) // v * v
        self.data = np.frombuffer(b"".join(strings) + b"\0" * 16, dtype=np.uint8)
        lens = np.array([len(x) for x in strings], dtype=np.int64)
        begin = np.cumsum(lens) - lens
        count = lens - length + 1
        self.at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.owner = np.repeat(np.arange(len(strings)), count)
        self.ahead = np.full((v, v), -1, dtype=np.int64)  # the next common cover place of two phases
        inside = np.isin(np.arange(2 * v) % v, places)
        for a in range(v):
            for b in range(v):
                self.ahead[a, b] = next(d for d in range(v) if inside[a + d] and inside[b + d])
        self.samples = self._samples(inside[:v])
        n_tail = length - self.window
        n_tail += -n_tail % 8
        self.tail = dense(_words(self.data, self.at + length - n_tail, n_tail))
        self.rank = self._parted(dense(_words(self.data, self.at, 8 * (-(-(v - 1) // 8)))))

    def _samples(self, chosen: np.ndarray) -> np.ndarray:
        """At each cover place, the rank of the `window` bytes there among all cover places' (elsewhere nothing of use).
        Pieces of v bytes are ranked first; the place v bytes on is in the cover too, so ranks of 1, 2, 4 ... pieces follow."""
        n, v = len(self.data) - 16, self.v
        at = np.flatnonzero(chosen[np.arange(n) % v])
        out = np.zeros(n + self.window + 1, dtype=np.int64)
        out[at] = dense(_words(self.data, np.minimum(at, n + 16 - 8 * (-(-v // 8))), v))
        have, want = 1, self.window // v
        while have < want:
            step = min(have, want - have)
            pair = out[at] * (len(at) + 1) + out[at + step * v]
            out[at] = np.unique(pair, return_inverse=True)[1]
            have += step
        return out

    def _parted(self, first: np.ndarray) -> np.ndarray:
        """Ranks by group of first bytes, then within each: a pivot of every group parts it in three, all groups at once."""
        order = np.argsort(first, kind="stable")
        group = first[order]  # in order, a group's members lie side by side
        rank = np.empty(len(order), dtype=np.int64)
        begin = np.arange(len(order))  # the places in order that are open
        while len(order):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(order)))
            which = np.cumsum(new) - 1
            alone = size[which] == 1
            rank[order[alone]] = begin[alone]
            open_ = ~alone
            if not open_.any():
                break
            pivot = order[(start + size // 2)[which[open_]]]
            mine, place = order[open_], begin[open_]
            a, b = self.at[mine], self.at[pivot]
            d = self.ahead[a % self.v, b % self.v]
            by_rank = np.sign(self.samples[a + d] - self.samples[b + d])
            side = np.where(by_rank != 0, by_rank, np.sign(self.tail[mine] - self.tail[pivot]))
            key = which[open_] * 3 + side + 1
            again = np.argsort(key, kind="stable")
            order, group, begin = mine[again], key[again], place
            # those equal to their pivot are done: they are tied
            same = group % 3 == 1
            head = np.flatnonzero(same & np.concatenate([[True], group[1:] != group[:-1]]))
            rank[order[same]] = begin[head][np.cumsum(np.isin(np.flatnonzero(same), head)) - 1] if len(head) else begin[:0]
            order, group, begin = order[~same], group[~same], begin[~same]
        return rank


def tied_runs(strings: list[bytes], times: np.ndarray, least: np.ndarray, length: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(string, starts, ends): the runs of tied suffixes of each string that has any. A string that occurs twice is tied
    with itself; where all strings of a least hash are such, there is nothing to sort."""
    alone = times == 1
    sort = np.isin(least, least[alone])
    out = [(int(i), np.array([0]), np.array([len(strings[i]) - length + 1])) for i in np.flatnonzero(~sort)]
    some = np.flatnonzero(sort)
    if not len(some):
        return out
    got = Sorted([strings[i] for i in some], length)
    weight = np.bincount(got.rank, weights=times[some][got.owner], minlength=len(got.rank))
    tied = weight[got.rank] > 1
    edge = np.flatnonzero(np.concatenate([[True], got.owner[1:] != got.owner[:-1]]))
    before, after = np.concatenate([[False], tied[:-1]]), np.concatenate([tied[1:], [False]])
    before[edge], after[edge[1:] - 1] = False, False
    starts, ends = np.flatnonzero(tied & ~before), np.flatnonzero(tied & ~after) + 1
    for i in np.unique(got.owner[starts]):
        own = got.owner[starts] == i if len(some) == 1 else slice(*np.searchsorted(got.owner[starts], [i, i + 1]))
        out.append((int(some[i]), starts[own] - edge[i], ends[own] - edge[i]))
    return out


# --- one block --------------------------------------------------------------------------------------------


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i:i + width] for each i up to len(x) - width."""
    n = len(x) - width + 1
    pad = np.concatenate([x, np.full(-len(x) % width, U64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class Part:
    """Some texts in a row, with one byte between them."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.raw = b"\0".join(texts) + b"\0"
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        lens = np.array([len(x) for x in texts], dtype=np.int64)
        self.start = np.cumsum(lens + 1) - lens - 1
        self.end = self.start + lens
        self.sums = common.Prefixes(self.data)

    def inside(self, length: int) -> np.ndarray:
        """Whether a string of that length at each place stays in its text."""
        change = np.zeros(len(self.data) + 1, dtype=np.int8)
        fits = self.end - self.start >= length
        change[self.start[fits]] += 1
        change[self.end[fits] - length + 1] -= 1
        return np.cumsum(change[:-1], dtype=np.int8) > 0

    def samples(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover places, and names of the bytes there."""
        v, places = cover(q)
        window = self.length - v + 1
        pattern = np.zeros(v, dtype=bool)
        pattern[places] = True
        size = self.end - self.start
        rows = np.tile(pattern, int(size.max(initial=0)) // v + 1)
        at = np.flatnonzero(np.concatenate([np.append(rows[:max(0, n - window + 1)], np.zeros(min(n, window - 1) + 1, dtype=bool)) for n in size.tolist()]))
        return at, self.sums.of(at, at + window)

    def suffixes(self, q: int, tied_at: np.ndarray) -> np.ndarray:
        """The places of suffixes with a tied cover place ahead."""
        v, _ = cover(q)
        ahead = np.zeros(len(self.data) + v + 1, dtype=np.int32)
        ahead[tied_at + 1] = 1
        ahead = np.cumsum(ahead, dtype=np.int32)
        return np.flatnonzero((ahead[v:-1] > ahead[:-v - 1]) & self.inside(self.length))

    def strings(self, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(first place, number of suffixes, least hash) of the strings that the places make."""
        if not len(at):
            return []
        gram = 16 if self.length >= 64 else 8
        # the bytes of all runs side by side: what lies between runs is no suffix's
        edge = np.concatenate([[True], at[1:] != at[:-1] + 1])
        begin = np.flatnonzero(edge)
        count = np.diff(np.append(begin, len(at)))
        room = count + self.length - 1
        first = np.cumsum(room) - room
        own = np.repeat(at[begin] - first, room) + np.arange(room.sum())
        data = np.append(self.data[own], np.zeros(8, dtype=np.uint8))
        words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).astype(U64)
        grams = common.mixed(words + U64(1))
        if gram == 16:
            grams = common.mixed(grams[:-8] ^ words[8:])
        here = np.repeat(first - begin, count) + np.arange(len(at))
        least = sliding_least(grams, self.length - gram + 1)[here]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])])
        begin = np.flatnonzero(new)
        # long runs of one least hash, as in a repeated letter, are cut where it is convenient
        nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(new | (nth % CUT == 0))
        return list(zip(at[begin].tolist(), np.diff(np.append(begin, len(at))).tolist(), least[begin].view(np.int64).tolist()))


def _keyed(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (names & U64(0xFFFFFFFF)).astype(np.uint32), ((names >> U64(32)) % U64(buckets)).astype(np.int64)


def _texts(pdf: pd.DataFrame, length: int):
    """Parts of the block's texts that are long enough, in a fixed order."""
    own = pdf[pdf["data"].str.len() >= length].drop_duplicates("digest").sort_values("doc_id", kind="stable")
    data = own["data"].tolist()
    for a, b in common.chunked(data):
        yield own["digest"].tolist()[a:b], data[a:b]


def _set(rows: pd.DataFrame) -> np.ndarray:
    """(bucket, key) of a block's tied keys as one number each, sorted."""
    keys = [common.grown(x).astype(U64) | U64(int(b)) << U64(32) for x, b in zip(rows["keys"], rows["bucket"])]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=U64)


def _pairs(keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return keys.astype(U64) | buckets.astype(U64) << U64(32)


def spans(docs: DataFrame, length: int = 400, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies() of docs, one row for each different text that loses bytes: digest, starts, ends, kept, text).

    starts and ends are the maximal runs of removed bytes; kept has the bytes that remain; text, their whole characters.
    """
    spark = docs.sparkSession
    own = common.stored(common.copies(docs, text), "copies")
    table, total = common.blocks(docs, own, text)
    q = prime_for(length)
    if not q:
        raise ValueError("length is too short for a difference cover")
    v, places = cover(q)
    least = 2 * common.cores(spark)
    n_first = int(max(least, total * len(places) / v // KEYS + 1))
    n_second = int(max(least, total * 0.25 // KEYS + 1))
    schema = "bucket int, block int, keys binary"

    def rows_of(keys: list, buckets: list, block: int) -> pd.DataFrame:
        common.given_back()
        rows = common.sent(np.concatenate(keys), np.concatenate(buckets), block) if keys else []
        return pd.DataFrame(rows, columns=["bucket", "block", "keys"])

    def samples(pdf):
        found = [_keyed(Part(data, length).samples(q)[1], n_first) for _, data in _texts(pdf, length)]
        return rows_of([k for k, _ in found], [b for _, b in found], int(pdf["block"].iloc[0]))

    first = common.stored(common.tied(table.groupBy("block").applyInPandas(samples, schema), "<u4"), "samples")

    def candidates(part: Part, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, names = part.samples(q)
        at = part.suffixes(q, at[common.member(_pairs(*_keyed(names, n_first)), ties)])
        return at, *_keyed(part.sums.of(at, at + length), n_second)

    def suffixes(key, pdf, ranked):
        ties, found = _set(ranked), []
        for _, data in _texts(pdf, length) if len(ties) else ():
            found.append(candidates(Part(data, length), ties)[1:])
        return rows_of([k for k, _ in found], [b for _, b in found], int(key[0]))

    second = common.stored(common.tied(table.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(suffixes, schema), "<u4"), "suffixes")
    common.swept(spark)
    both = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))

    def strings(key, pdf, keys):
        ties, equal = _set(keys[keys["step"] == 1]), _set(keys[keys["step"] == 2])
        out, seen = [], set()
        for digests, data in _texts(pdf, length) if len(equal) else ():
            part = Part(data, length)
            at, k, b = candidates(part, ties)
            for p, n, low in part.strings(at[common.member(_pairs(k, b), equal)]):
                i = int(np.searchsorted(part.start, p, "right")) - 1
                x = part.raw[p:p + n + length - 1]
                name = hashlib.blake2b(x, digest_size=20).digest()
                out.append((int(key[0]), digests[i], p - int(part.start[i]), name, None if name in seen else x, low))
                seen.add(name)
        common.given_back()
        return pd.DataFrame(out, columns=["block", "digest", "at", "name", "data", "least"])

    places_of = common.stored(table.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(
        strings, "block int, digest binary, at long, name binary, data binary, least long"), "strings")
    common.swept(spark)
    each = common.stored(places_of.groupBy("name").agg(F.first("data", True).alias("data"), F.first("least").alias("least"),
                                                       F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("times")), "different")
    size = each.agg(F.sum(F.octet_length("data").cast("long"))).head()[0] or 0
    dealt = each.withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(int(max(least, size // BUCKET + 1)))).cast("int"))

    def order(pdf):
        data = pdf["data"].tolist()
        out = [(pdf["name"].iloc[i], s, e) for i, s, e in tied_runs(data, pdf["times"].to_numpy(), pdf["least"].to_numpy(), length)]
        common.given_back()
        return pd.DataFrame(out, columns=["name", "starts", "ends"])

    tied = dealt.groupBy("bucket").applyInPandas(order, "name binary, starts array<int>, ends array<int>")
    runs = common.stored(places_of.select("block", "digest", "at", "name").join(tied, "name").drop("name"), "runs")

    def removed(key, pdf, found):
        out, texts = [], dict(zip(pdf["digest"], pdf["data"])) if len(found) else {}
        for digest, own in found.groupby("digest", sort=False):
            data = texts[digest]
            begin = np.concatenate([a + s for a, s in zip(own["at"], own["starts"])])
            last = np.concatenate([a + e for a, e in zip(own["at"], own["ends"])])
            sort = np.argsort(begin, kind="stable")
            begin, last = begin[sort], np.maximum.accumulate(last[sort]) + length - 1
            fresh = np.concatenate([[True], begin[1:] > last[:-1]])
            starts, ends = begin[fresh], last[np.concatenate([fresh[1:], [True]])]
            kept = b"".join(data[p:n] for p, n in zip([0, *ends], [*starts, len(data)]))
            out.append((digest, starts, ends, kept, kept.decode("utf-8", "ignore")))
        common.given_back()
        return pd.DataFrame(out, columns=["digest", "starts", "ends", "kept", "text"])

    done = table.groupBy("block").cogroup(runs.groupBy("block")).applyInPandas(
        removed, "digest binary, starts array<long>, ends array<long>, kept binary, text string")
    return own, done


def _whole(length: int):
    """Equal texts that are long enough go as a whole."""
    return (F.col("n_copies") > 1) & (F.col("n_bytes") >= length)


def report(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    own, done = spans(docs, length, text)
    n = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    found = done.select("digest", n.alias("_n"), F.size("starts").cast("long").alias("_s"), F.sha2("kept", 256).alias("_k"))
    long_ = F.col("n_bytes") >= length
    alone = own.filter(long_ & (F.col("n_copies") == 1)).join(found, "digest", "left").select(
        "doc_id", "n_bytes", F.coalesce("_n", F.lit(0)).alias("n_removed"), F.coalesce("_s", F.lit(0)).alias("n_spans"),
        F.coalesce("_k", F.lower(F.hex("digest"))).alias("kept_sha256"))
    none = F.lit(0).cast("long")
    short = own.filter(~long_).select("doc_id", "n_bytes", none, none, F.lower(F.hex("digest")))
    return alone.union(short).union(own.filter(_whole(length)).select(
        "doc_id", "n_bytes", F.col("n_bytes"), F.lit(1).cast("long"), F.sha2(F.lit("").cast("binary"), 256)))


def deduplicated(docs: DataFrame, length: int = 400, text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs whose texts are what remains; a character that was cut goes as a whole. Rows left empty stay, empty, unless
    they are to be dropped; rows that were empty or null before always stay.

    Texts of many rows lose all or nothing, which needs no text: their digests travel, and their rows are dealt by id, so
    one text in a third of all rows is no hot spot.
    """
    own, done = spans(docs, length, text)
    cut = done.select("digest", F.col("text").alias("kept"))
    gone = own.filter(_whole(length)).select("digest", F.lit("").alias("kept")).distinct()
    found = cut.join(gone, "digest", "left_anti").union(gone)
    many = own.filter((F.col("n_copies") > 1) & (F.col("n_copies") * common.HOT > own.count())).select("digest", _whole(length).alias("_w")).distinct()  # HOT at most
    rows = docs.select(common.whole_rows(docs), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    rows = rows.join(F.broadcast(many), "digest", "left")
    spread = F.concat("digest", F.pmod(F.xxhash64("row.doc_id"), F.lit(4096)).cast("string").cast("binary"))
    rows = rows.withColumn("_k", F.when(F.col("_w").isNull(), F.col("digest")).otherwise(spread))
    rows = rows.join(found.select(F.col("digest").alias("_k"), F.col("kept").alias("_f")), "_k", "left").withColumn("kept", F.when(F.col("_w"), "").otherwise(F.col("_f")))
    if drop_emptied:
        rows = rows.filter(F.col("kept").isNull() | (F.col("kept") != ""))
    new = F.when(F.col("kept").isNull(), F.col(f"row.`{text}`")).otherwise(F.col("kept"))
    return rows.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))

"""Vector code compression: product codes whose codebooks are fitted by filtering Lloyd rounds.

Every partition cuts its vectors, BLOCK at a time, into parts and builds one kd-tree for each part position: nodes hold
the bounding box, sum and count of their rows, which lie side by side. A round walks all trees level by level. A node
keeps the codebook entries that may be nearest to some point of its box: an entry goes if even at the box's corner that
favours it most it is farther than the entry nearest to the box's middle (or as far, with a higher index). A node with
one entry left is assigned whole, by its cached sum and count; leaves with several compare their points. Only sums and
counts leave the tasks, at most one row for each part position and entry, and their totals, which the driver turns into
the next codebooks: `entries` times the dimension numbers, whatever the table's size.

All arithmetic is in 64-bit integers: distances, sums and ties are exact.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors, and lengths that don't
divide into the parts, count as followed by zeros; rows without an id stay (for the first codebooks they come last); rows
that repeat an id each have a row; with fewer rows than entries there are as many entries as rows; equal distances go to
the lower entry; null labels are one label; other columns are left out; an empty table gives no rows. Components beyond
LIMIT are refused with an error, since errors would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ann, common

BLOCK, LEAF = 8192, 16
#: Numbers that a step of a walk compares at a time.
TABLE = 1 << 20
#: Scaled components are below this: a squared distance of a part of up to 64 components then has less than 61 bits.
LIMIT = 1 << 26


class Tree:
    """A kd-tree over rows of whole numbers; node i has the rows first[i] to last[i] of `points`, left[i] is -1 at leaves."""

    FIELDS = ("order", "points", "first", "last", "left", "right", "low", "high", "total")

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        first, last, left, right = [0], [len(points)], [-1], [-1]
        i = 0
        while i < len(first):
            a, z = first[i], last[i]
            own = points[order[a:z]]
            spread = own.max(axis=0) - own.min(axis=0)
            if z - a > LEAF and spread.any():
                middle = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(own[:, spread.argmax()], middle)]
                left[i], right[i] = len(first), len(first) + 1
                first += [a, a + middle]
                last += [a + middle, z]
                left += [-1, -1]
                right += [-1, -1]
            i += 1
        self.order, self.points = order, points[order]
        self.first, self.last, self.left, self.right = (np.array(x, dtype=np.int64) for x in (first, last, left, right))
        sums = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(self.points, axis=0)])
        self.total = sums[self.last] - sums[self.first]
        self.low, self.high = np.zeros_like(self.total), np.zeros_like(self.total)
        for i in reversed(range(len(first))):
            if left[i] < 0:
                own = self.points[first[i]:last[i]]
                self.low[i], self.high[i] = own.min(axis=0), own.max(axis=0)
            else:
                self.low[i] = np.minimum(self.low[left[i]], self.low[right[i]])
                self.high[i] = np.maximum(self.high[left[i]], self.high[right[i]])

    def pickled(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k).astype(np.int64 if k == "total" else np.int32) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def restored(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in cls.FIELDS:
                setattr(tree, k, z[k].astype(np.int64))
        return tree

    def walk(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(nodes, entries, None) for nodes that go to one entry whole, and (rows, entries, distances) for single points."""
        entries = np.arange(len(book))
        square = (book * book).sum(axis=1)
        todo, step = [(np.zeros(1, dtype=np.int64), np.ones((1, len(book)), dtype=bool))], max(1, TABLE // (LEAF * book.size))
        while todo:
            nodes, maybe = todo.pop()
            if len(nodes) > step:
                todo.append((nodes[step:], maybe[step:]))
                nodes, maybe = nodes[:step], maybe[:step]
            low, high = self.low[nodes], self.high[nodes]
            # twice the distance to the middle, for the entries that are left
            off = (low + high)[:, None, :] - 2 * book[None, :, :]
            near = np.where(maybe, (off * off).sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            # the nearest entry's distance less another's is linear in the point, so largest at a corner
            way = 2 * (book[None, :, :] - book[near][:, None, :])
            most = np.where(way > 0, way * high[:, None, :], way * low[:, None, :]).sum(axis=2) + square[near][:, None] - square[None, :]
            maybe &= (most > 0) | (most == 0) & (entries[None, :] < near[:, None])
            maybe[np.arange(len(nodes)), near] = True
            alone = maybe.sum(axis=1) == 1
            if alone.any():
                yield nodes[alone], near[alone], None
            nodes, maybe = nodes[~alone], maybe[~alone]
            leaf = self.left[nodes] < 0
            if leaf.any():
                sizes = self.last[nodes[leaf]] - self.first[nodes[leaf]]
                at = np.repeat(np.arange(leaf.sum()), sizes)
                rows = np.repeat(self.first[nodes[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(at))
                off = self.points[rows][:, None, :] - book[None, :, :]
                far = np.where(maybe[leaf][at], (off * off).sum(axis=2), np.iinfo(np.int64).max)
                best = far.argmin(axis=1)
                yield rows, best, far[np.arange(len(rows)), best]
            inner = nodes[~leaf]
            if len(inner):
                todo.append((np.concatenate([self.left[inner], self.right[inner]]), np.concatenate([maybe[~leaf], maybe[~leaf]])))

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the rows of each entry."""
        total, count = np.zeros_like(book), np.zeros(len(book), dtype=np.int64)
        for at, entry, far in self.walk(book):
            np.add.at(total, entry, self.points[at] if far is not None else self.total[at])
            np.add.at(count, entry, 1 if far is not None else self.last[at] - self.first[at])
        return total, count

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row, in the order given."""
        entry = np.zeros(len(self.points), dtype=np.int64)
        for at, own, far in self.walk(book):
            if far is not None:
                entry[at] = own
            else:
                for a, z, e in zip(self.first[at], self.last[at], own):
                    entry[a:z] = e
        off = self.points - book[entry]
        out = np.zeros((2, len(entry)), dtype=np.int64)
        out[:, self.order] = entry, (off * off).sum(axis=1)
        return out[0], out[1]


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partition's rows, BLOCK at a time."""
    held, n = [], 0
    for pdf in batches:
        while len(pdf):
            held.append(pdf.iloc[:BLOCK - n])
            n += len(held[-1])
            pdf = pdf.iloc[len(held[-1]):]
            if n == BLOCK:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def fitted(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks (part, entry, component): the floor of each entry's mean, or the entry if it has no rows."""
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros_like(books), np.zeros((parts, entries), dtype=np.int64)
        for pdf in batches:
            for own in pdf["trees"]:
                for part, data in enumerate(own):
                    t, c = Tree.restored(data).sums(books[part])
                    total[part] += t
                    count[part] += c
        part, entry = np.nonzero(count)
        for d in range(width):
            yield pd.DataFrame({"part": part, "entry": entry, "d": d, "total": total[part, entry, d], "count": count[part, entry]})

    sums = trees.select("trees").mapInPandas(run, "part int, entry int, d int, total long, count long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "d").agg(F.sum("total").alias("total"), F.sum("count").alias("n")).collect():
        out[r["part"], r["entry"], r["d"]] = r["total"] // r["n"]
    return out


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec: str = "embedding",
               label: str = "label") -> DataFrame:
    """vec_id, code (two hexadecimal digits for each part), error, label_error (the sum over the rows of a label) and
    codebooks_sha256. The codebooks start as the parts of the rows with the `entries` smallest ids."""
    spark = vectors.sparkSession
    common.lean(spark)
    name = F.when(F.col(label).isNotNull(), F.concat(F.lit("="), F.col(label).cast("string"))).otherwise("")
    scaled = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(ann.whole(F.col(vec))).select("vec_id", name.alias("label"), scaled.alias("v"))
    longest, low, high = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).head()
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if max(-(low or 0), high or 0) >= LIMIT:
        raise ValueError(f"components must be below {LIMIT / scale:g}")
    width = max(1, -(-longest // parts))

    def cut(values) -> np.ndarray:
        out = np.zeros((len(values), parts * width), dtype=np.int64)
        for i, v in enumerate(values):
            out[i, :len(v)] = v
        return out.reshape(len(values), parts, width)

    def planted(batches):
        for own in _gathered(batches):
            points = cut(own["v"])
            yield pd.DataFrame({"ids": [own["ids"].tolist()], "labels": [own["label"].tolist()], "trees": [[Tree(points[:, k]).pickled() for k in range(parts)]]})

    numbered = rows.select(F.col("vec_id").cast("string").alias("ids"), "label", "v")  # as text, since pandas has no null among whole numbers
    trees = common.stored(numbered.mapInPandas(planted, "ids array<string>, labels array<string>, trees array<binary>"), "trees")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.ascontiguousarray(cut([r["v"] for r in first]).transpose(1, 0, 2))
    for _ in range(rounds):
        books = fitted(trees, books)

    def coded(batches):
        for pdf in batches:
            for own in pdf.itertuples(index=False):
                entry, error = zip(*(Tree.restored(t).assigned(book) for t, book in zip(own.trees, books)))
                digits = np.array([f"{e:02x}" for e in range(books.shape[1])])[np.array(entry).T]
                yield pd.DataFrame({"vec_id": own.ids, "label": own.labels, "code": ["".join(x) for x in digits], "error": np.array(error).sum(axis=0)})

    found = common.stored(trees.mapInPandas(coded, "vec_id string, label string, code string, error long"), "codes")
    of_label = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return common.met(found, of_label, "label", "n").select(
        F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

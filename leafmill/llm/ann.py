"""Approximate nearest neighbours by cross-polytope hashing.

A rotation turns each unit vector by three rounds of random signs and a fast Hadamard transform, and names its nearest
signed axis. A table joins the axes of as many rotations as it takes to have a cell for every two vectors; the last of
them has only some of its axes. Vectors are hashed by direction, in bands of length (a quarter of a doubling each) with
cells of their own, so that a few long ones don't press the others together. A query asks, in each band of n vectors,
for SPREAD * n ** GROWTH cells of all tables: those whose axes lose least against the query's nearest ones. So the share
of a band that is reached falls as it grows.

Cells give pairs of places in blocks of vectors and of queries; only places move, packed. Each pair of blocks that
has any is one task's, which takes both blocks' vectors, and ranks each query's candidates by the exact inner product in
double precision. Equal vectors are one vector with its k + 1 smallest ids (no more can be among the k nearest), and equal
queries are asked once. Queries that find fewer than k (or than there are) are searched among all rows, exactly.

Recall and reach depend on the vectors: README has figures, and reach() measures.

Cases: vectors that are null, all zero, or hold null, NaN or infinite numbers take no part, nor do rows without an id;
shorter vectors count as followed by zeros; equal scores go to the smaller id; rows that repeat an id are one candidate,
with its best score, and a query is searched once for each row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELL, ASKED = 8192, 4096
#: Pairs of a query and a vector whose exact scores are taken at a time.
PAIRS = 1 << 16


def whole(vec: Column) -> Column:
    """Whether all components are finite numbers."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def padded(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def best(ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, bytes, bytes]]:
    """(query, ids, scores) of the k best for each query: those that may be so by a matrix product, by exact score, whose
    sums always run in the same order."""
    rough = queries @ vectors.T
    rough[ids[None, :] == names[:, None]] = -np.inf
    least = max(0, len(ids) - k)
    edge = np.partition(rough, least, axis=1)[:, least, None] if least else np.full((len(names), 1), -np.inf)
    with np.errstate(invalid="ignore"):
        at, near = np.nonzero((rough > -np.inf) & ~(rough < edge - 1e-9 * (1 + np.abs(edge))))
    score = np.concatenate([np.zeros(0), *((vectors[near[i:i + PAIRS]] * queries[at[i:i + PAIRS]]).sum(axis=1) for i in range(0, len(at), PAIRS))])
    order = np.lexsort((ids[near], -score, at))
    at, near, score = at[order], near[order], score[order]
    first = np.searchsorted(at, np.arange(len(names)))
    last = np.minimum(first + k, np.append(first[1:], len(at)))
    return [(names[i], ids[near[a:z]].tobytes(), score[a:z].tobytes()) for i, (a, z) in enumerate(zip(first, last)) if z > a]


def searched(rows: DataFrame, queries: DataFrame, dim: int, k: int, bundles: int) -> DataFrame:
    """(query_id, ids, scores) for rows (cell, vec_id, data) and queries of the same kind; of cells there are few."""
    left = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_k"))
    right = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_m"))
    grid = F.broadcast(left.join(right, "cell"))
    bundle = F.pmod(F.xxhash64("cell"), F.lit(bundles)).alias("bundle")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    files = rows.join(grid, "cell").select(bundle, own("_k").alias("i"), every("_m").alias("j"), "cell", "vec_id", "data")
    asking = queries.join(grid, "cell").select(bundle, every("_k").alias("i"), own("_m").alias("j"), "cell", "vec_id", "data")

    def run(left, right):
        out = []
        if len(left) and len(right):
            there = {c: g for c, g in left.groupby("cell", sort=False)}
            for cell, asked in right.groupby("cell", sort=False):
                if cell not in there:
                    continue
                own = there[cell]
                ids, vectors = own["vec_id"].to_numpy(), padded([np.frombuffer(x) for x in own["data"]], dim)
                names = asked["vec_id"].to_numpy()
                q = padded([np.frombuffer(x) for x in asked["data"]], dim)
                for a in range(0, len(q), 256):
                    out += best(ids, vectors, names[a:a + 256], q[a:a + 256], k)
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    key = ["bundle", "i", "j"]
    return files.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(run, "query_id long, ids binary, scores binary")


def merged(found: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all parts' results, each id once."""

    def run(pdf):
        n = [len(x) // 8 for x in pdf["ids"]]
        rows = pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "vec_id": np.frombuffer(b"".join(pdf["ids"]), dtype=np.int64),
                             "score": np.frombuffer(b"".join(pdf["scores"]), dtype=np.float64)})
        rows = rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        rows.insert(1, "rank", rows.groupby("query_id").cumcount() + 1)
        return rows[rows["rank"] <= k]

    dealt = found.withColumn("_p", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    return dealt.groupBy("_p").applyInPandas(run, "query_id long, rank int, vec_id long, score double")


#: Cells that a query asks for in a band of n vectors; bands to a doubling of length; vectors of a block.
SPREAD, GROWTH, BANDS, ROWS = 16, 0.42, 4, 2048
#: More places than a block has, whose rows are dealt by hash.
PLACES = 1 << 15


def _axes(n: int, width: int) -> list[int]:
    """How many axes (each with both signs) every rotation of a table has, for n vectors: about a cell for every two."""
    out, left = [], max(1, n // 2)
    while left > 1 and len(out) < 4:
        out.append(min(width, max(1, left // 2)))
        left //= 2 * out[-1]
    return out


def _along(x: np.ndarray, seed: int, table: int, rotation: int, axes: int) -> np.ndarray:
    """Along each signed axis of a rotation: its first ones, and then the same with the other sign."""
    signs = np.random.default_rng([seed, table, rotation]).choice([-1.0, 1.0], size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)


def cells(x: np.ndarray, n: int, table: int, seed: int) -> np.ndarray:
    """The cell of each unit vector in a table for n vectors."""
    out = np.zeros(len(x), dtype=np.int64)
    for r, axes in enumerate(_axes(n, x.shape[1])):
        out = out * 2 * axes + _along(x, seed, table, r, axes).argmax(axis=1)
    return out


def asked_cells(x: np.ndarray, n: int, tables: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, table, cell) of the cells that each unit vector asks for: of all tables those that lose least, where a cell's
    loss is the sum over its rotations of the squared distance from the nearest axis."""
    axes, loss, cell = _axes(n, x.shape[1]), [], []
    each = int(np.ceil((4 * probes / tables) ** (1 / max(1, len(axes))))) + 3
    for t in range(tables):
        own, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for r, m in enumerate(axes):
            along = _along(x, seed, t, r, m)
            take = min(2 * m, each)
            near = np.argpartition(-along, take - 1, axis=1)[:, :take]
            less = (along.max(axis=1, keepdims=True) - np.take_along_axis(along, near, axis=1)) ** 2
            own = (own[:, :, None] + less[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * 2 * m + near[:, None, :]).reshape(len(x), -1)
        loss.append(own)
        cell.append(code)
    size = loss[0].shape[1]
    loss, cell = np.concatenate(loss, axis=1), np.concatenate(cell, axis=1)
    take = min(probes, loss.shape[1])
    pick = np.argpartition(loss, take - 1, axis=1)[:, :take]
    return np.repeat(np.arange(len(x)), take), (pick // size).ravel(), np.take_along_axis(cell, pick, axis=1).ravel()


def _distinct(rows: DataFrame, dim: int, most: int | None) -> DataFrame:
    """data (the vector's bytes, padded), name (its digest), ids: different vectors with their ids, the `most` smallest of
    them or none at all."""
    def run(batches):
        for pdf in batches:
            data = [x.tobytes() for x in padded(pdf["v"].tolist(), dim) + 0.0]  # one kind of zero
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "data": data, "name": [hashlib.blake2b(x, digest_size=16).digest() for x in data]})

    each = rows.mapInPandas(run, "vec_id long, data binary, name binary")
    if most is None:
        return each
    few = each.dropDuplicates(["name", "vec_id"]).withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("vec_id"))).filter(F.col("_r") <= most)
    return few.groupBy("name").agg(F.first("data").alias("data"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _blocked(vectors: DataFrame) -> DataFrame:
    """block, names, ids (a list of bytes for each vector), data: about ROWS vectors to a row, however they were dealt."""
    held = common.stored(vectors, "different")
    n = max(1, -(-held.count() // ROWS))

    def run(pdf):
        pdf = pdf.sort_values("name")
        return pd.DataFrame([(pdf["block"].iloc[0], pdf["name"].tolist(), [np.asarray(x, dtype=np.int64).tobytes() for x in pdf["ids"]], b"".join(pdf["data"]))],
                            columns=["block", "names", "ids", "data"])

    dealt = held.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(n)))
    return dealt.groupBy("block").applyInPandas(run, "block long, names array<binary>, ids array<binary>, data binary")


def _unit(data: bytes, dim: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and the number of each one's band."""
    x = np.zeros((len(data) // 8 // dim, width))
    x[:, :dim] = np.frombuffer(data).reshape(-1, dim)
    largest = np.abs(x).max(axis=1, keepdims=True)
    size = np.sqrt(((x / largest) ** 2).sum(axis=1, keepdims=True))
    return x / largest / size, np.floor(BANDS * (np.log2(largest) + np.log2(size)) + 0.5).ravel().astype(np.int64)


def _bundled(block: int, codes: np.ndarray, places: np.ndarray, bundles: int) -> pd.DataFrame:
    """Codes (of band, table and cell) and places of a block, by bundle."""
    bundle = (common.mixed(codes.astype(np.uint64)) % np.uint64(bundles)).astype(np.int64)
    order = np.lexsort((codes, bundle))
    codes, places, bundle = codes[order], places[order].astype(np.int32), bundle[order]
    cut = np.flatnonzero(np.concatenate([[True], bundle[1:] != bundle[:-1]])) if len(bundle) else np.zeros(0, dtype=int)
    return pd.DataFrame([(int(bundle[a]), block, codes[a:z].tobytes(), places[a:z].tobytes()) for a, z in zip(cut, [*cut[1:], len(bundle)])],
                        columns=["bundle", "block", "codes", "places"])


def _code(band: int, table, cell):
    """One number for a cell of all; two that share it only give each other more candidates."""
    x = np.asarray(cell).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + common.mixed(np.atleast_1d(np.asarray(table, dtype=np.uint64)) + np.uint64((band + (1 << 20)) << 20))
    return common.mixed(x).astype(np.int64)


def _found(filed: DataFrame, asked: DataFrame) -> DataFrame:
    """asking, block, pairs: places of queries and vectors (in one number) that meet in a cell, for each pair of blocks."""
    def run(left, right):
        out = []
        if len(left) and len(right):
            codes = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in left["codes"]])
            places = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in left["places"]])
            owner = np.repeat(np.arange(len(left)), [len(x) // 8 for x in left["codes"]])
            order = np.argsort(codes, kind="stable")
            codes, places, owner, blocks = codes[order], places[order], owner[order], left["block"].to_numpy()
            for block, c, p in zip(right["block"], right["codes"], right["places"]):
                c, p = np.frombuffer(c, dtype=np.int64), np.frombuffer(p, dtype=np.int32)
                first = np.searchsorted(codes, c)
                n = np.searchsorted(codes, c, "right") - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                pair, who = np.repeat(p, n) * PLACES + places[at], owner[at]
                order = np.argsort(who, kind="stable")
                cut = np.searchsorted(who[order], np.arange(len(blocks) + 1))
                out += [(block, blocks[i], np.unique(pair[order[a:z]]).tobytes()) for i, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
        return pd.DataFrame(out, columns=["asking", "block", "pairs"])

    return filed.groupBy("bundle").cogroup(asked.groupBy("bundle")).applyInPandas(run, "asking long, block long, pairs binary")


def _ranked(found: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """name, ids, scores, reached: for each query the k + 1 best ids of one block of vectors, and how many vectors it met."""
    tile = ["asking", "block"]
    met = found.select(*(F.col(c).alias(c) for c in tile)).distinct()
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    sides = met.join(vectors, "block").select(*tile, none("names", "array<binary>"), "ids", "data").unionByName(
        met.join(queries.select(F.col("block").alias("asking"), "names", "data"), "asking").select(*tile, "names", none("ids", "array<binary>"), "data"))

    def run(left, right):
        out = []
        if len(left) and len(right) == 2:
            mine, its = (right[right[c].notna()].iloc[0] for c in ("names", "ids"))
            q, v = (np.frombuffer(x["data"]).reshape(-1, dim) for x in (mine, its))
            ids = [np.frombuffer(x, dtype=np.int64) for x in its["ids"]]
            least = np.array([x[0] for x in ids])
            pairs = np.unique(np.concatenate([np.frombuffer(x, dtype=np.int32) for x in left["pairs"]]))
            at, near = pairs // PLACES, pairs % PLACES
            score = np.concatenate([(q[at[i:i + PAIRS]] * v[near[i:i + PAIRS]]).sum(axis=1) for i in range(0, len(at), PAIRS)])
            order = np.lexsort((least[near], -score, at))
            at, near, score = at[order], near[order], score[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            for a, z in zip(first, [*first[1:], len(at)]):
                some = near[a:min(z, a + k + 1)]
                own, s = np.concatenate([ids[i] for i in some]), np.repeat(score[a:a + len(some)], [len(ids[i]) for i in some])
                pick = np.lexsort((own, -s))[:k + 1]
                out.append((mine["names"][at[a]], own[pick].tobytes(), s[pick].tobytes(), z - a))
        return pd.DataFrame(out, columns=["name", "ids", "scores", "reached"])

    return found.groupBy(*tile).cogroup(sides.groupBy(*tile)).applyInPandas(run, "name binary, ids binary, scores binary, reached long")


def _best(found: DataFrame, k: int, parts: int) -> DataFrame:
    """name, ids, scores, reached: of all blocks' results, each id once."""
    def run(pdf):
        out = []
        for name, own in pdf.groupby("name", sort=False):
            ids = np.frombuffer(b"".join(own["ids"]), dtype=np.int64)
            score = np.frombuffer(b"".join(own["scores"]), dtype=np.float64)
            order = np.lexsort((ids, -score))
            ids, score = ids[order], score[order]
            first = np.sort(np.unique(ids, return_index=True)[1])[:k + 1]
            out.append((name, ids[first].tobytes(), score[first].tobytes(), own["reached"].sum()))
        return pd.DataFrame(out, columns=["name", "ids", "scores", "reached"])

    dealt = found.withColumn("_p", F.pmod(F.xxhash64("name"), F.lit(parts)))
    return dealt.groupBy("_p").applyInPandas(run, "name binary, ids binary, scores binary, reached long")


def _candidates(rows: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows of queries: vec_id, name; results: name, ids, scores, reached) by the cells."""
    spark = rows.sparkSession
    common.lean(spark)
    width = 1 << max(0, int(dim - 1).bit_length())
    vectors = common.stored(_blocked(_distinct(rows, dim, k + 1)), "vectors")
    own = common.stored(_distinct(asked, dim, None), "asked")
    queries = common.stored(_blocked(own.groupBy("name").agg(F.first("data").alias("data")).withColumn("ids", F.array().cast("array<long>"))), "queries")

    def counted(batches):
        for pdf in batches:
            for data in pdf["data"]:
                band, n = np.unique(_unit(data, dim, width)[1], return_counts=True)
                yield pd.DataFrame({"band": band, "n": n})

    sizes = {r["band"]: r["n"] for r in vectors.select("data").mapInPandas(counted, "band long, n long").groupBy("band").agg(F.sum("n").alias("n")).collect()}  # a few thousand lengths there can be
    bundles = int(max(4 * common.cores(spark), sum(sizes.values()) * tables // 262144))

    def filing(batches):
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"]):
                x, band = _unit(data, dim, width)
                codes, places = [], []
                for b in np.unique(band):
                    at = np.flatnonzero(band == b)
                    for t in range(tables):
                        codes.append(_code(int(b), t, cells(x[at], sizes[b], t, seed)))
                        places.append(at)
                yield _bundled(block, np.concatenate(codes), np.concatenate(places), bundles)

    def asking(batches):
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"]):
                x, _ = _unit(data, dim, width)
                for b, n in sizes.items():
                    for i in range(0, len(x), 256):
                        at, table, cell = asked_cells(x[i:i + 256], n, tables, int(np.ceil(SPREAD * n**GROWTH)), seed)
                        yield _bundled(block, _code(int(b), table, cell), at + i, bundles)

    schema = "bundle long, block long, codes binary, places binary"
    filed = common.stored(vectors.select("block", "data").mapInPandas(filing, schema), "cells")
    probing = common.stored(queries.select("block", "data").mapInPandas(asking, schema), "probes")
    found = common.stored(_found(filed, probing), "pairs")
    parts = 2 * common.cores(spark)
    return own.select("vec_id", "name"), common.stored(_best(_ranked(found, vectors, queries, dim, k), k, parts), "nearest")


def _taken(vectors: DataFrame, queries: DataFrame, vec: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows and queries that take part (vec_id, v), how many ids the rows have, and their dimension."""
    take = lambda df: df.filter(F.col("vec_id").isNotNull() & whole(F.col(vec)) & F.exists(vec, lambda x: x != 0)).select(
        "vec_id", F.col(vec).cast("array<double>").alias("v"))
    rows, asked = take(vectors), take(queries)
    n, dim = rows.agg(F.count_distinct("vec_id"), F.max(F.size("v"))).head()
    return rows, asked, n, max(dim or 1, asked.agg(F.max(F.size("v"))).head()[0] or 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", tables: int = 64, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score for every row of queries (vec_id and vec), searched among the rows of vectors."""
    spark = vectors.sparkSession
    rows, asked, n, dim = _taken(vectors, queries, vec)
    own, found = _candidates(rows, asked, dim, k, tables, seed)
    # a query may be one of many equal ones: their number is known, and its result meets them where they are
    facts = own.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).join(found.drop("reached"), "name")
    met = common.met(own, common.stored(facts, "results"), "name", "_n")

    def spread(batches):
        for pdf in batches:
            out = []
            for me, ids, score in zip(pdf["vec_id"], pdf["ids"], pdf["scores"]):
                ids, score = np.frombuffer(ids, dtype=np.int64), np.frombuffer(score)
                stay = np.flatnonzero(ids != me)[:k]
                out += [(me, r, i, s) for r, (i, s) in enumerate(zip(ids[stay].tolist(), score[stay].tolist()), 1)]
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    first = common.stored(met.select("vec_id", "ids", "scores").mapInPandas(spread, "query_id long, rank int, vec_id long, score double"), "spread")
    full = first.filter(F.col("rank") == max(1, min(k, n - 1))).select(F.col("query_id").alias("vec_id")).distinct()
    few = common.stored(asked.join(full, "vec_id", "left_anti"), "few")
    if few.isEmpty():
        return first
    # what the cells don't give enough of is searched exactly
    alike = lambda df: _blobs(df).withColumn("cell", F.lit(0))
    again = merged(searched(common.stored(alike(rows), "rows"), alike(few), dim, k, 1), k, 2 * common.cores(spark))
    return first.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").union(again)


def reach(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", tables: int = 64, seed: int = 1) -> float:
    """The mean share of different vectors that a query is compared with."""
    rows, asked, _, dim = _taken(vectors, queries, vec)
    _, found = _candidates(rows, asked, dim, k, tables, seed)
    return (found.agg(F.avg("reached")).head()[0] or 0.0) / max(1, rows.select("v").distinct().count())


def _blobs(rows: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "data": [np.asarray(v, dtype=np.float64).tobytes() for v in pdf["v"]]})

    return rows.mapInPandas(run, "vec_id long, data binary")

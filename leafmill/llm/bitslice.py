"""Exact top-k by inner product with a bit-sliced index.

A block of rows is stored as bitmaps: slice s of attribute d has a row's bit set if bit s of its quantised value (less
the table's least value) is set. A query's score is a sum of shifted slices; a negative weight takes the slices'
complement. Bitmaps of equal value are added three at a time (sum and carry) until one is left at each power of two.
The k best rows are then found from the most significant sum down: while a slice alone holds too many rows, the search
goes on among those; rows that are still equal at the end differ in id only, and the smaller ids win.

A block is dealt once for each PART queries, and queries, packed QUERIES to a row, once for each block: both ways move
about as many bytes, and a task holds one block and one part of the queries. Each gives its own k best for each query,
which merge exactly.

Cases: vectors that are null, or hold null, NaN or infinite numbers take no part, nor do rows without an id; shorter
vectors count as followed by zeros; rows that repeat an id are one candidate, with its best score; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ann, common

ROWS = 32768
QUERIES = 64
#: Queries that meet a block in one task: some 2 MB of them, as the block has.
PART = 4096


def quantised(vec: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """(attributes, bits, words) of a block (rows, attributes) of numbers from 0 up."""
    n, d = values.shape
    words = -(-n // 64)
    out = np.zeros((d, bits, words * 8), dtype=np.uint8)
    for s in range(bits):
        out[:, s, :-(-n // 8)] = np.packbits((values.T >> s & 1).astype(bool), axis=1, bitorder="little")
    return out.view(np.uint64)


def added(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """One bitmap for each power of two: the sum of all bitmaps given by power."""
    out, power = [], 0
    carried: dict[int, list[np.ndarray]] = {}
    while power <= max([*columns, *carried], default=-1):
        own = [*columns.get(power, []), *carried.pop(power, [])]
        now = np.concatenate(own) if own else np.zeros((0, words), dtype=np.uint64)
        up = carried.setdefault(power + 1, [])
        while len(now) > 2:
            m = len(now) // 3
            a, b, c = now[:m], now[m:2 * m], now[2 * m:3 * m]
            half = a ^ b
            up.append(a & b | half & c)
            now = np.concatenate([half ^ c, now[3 * m:]])
        if len(now) == 2:
            up.append(now[:1] & now[1:])
            now = now[:1] ^ now[1:]
        if not up:
            carried.pop(power + 1)
        out.append(now[0] if len(now) else np.zeros(words, dtype=np.uint64))
        power += 1
    return out


def scores(slices: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of sum(weight * value) + constant, and that constant."""
    columns: dict[int, list[np.ndarray]] = {}
    top = (1 << slices.shape[1]) - 1
    const = 0
    for sign in (1, -1):
        weights = np.maximum(0, sign * query)
        if sign < 0:
            const = int(weights.sum()) * top
        for b in range(int(weights.max(initial=0)).bit_length()):
            some = slices[(weights >> b & 1) == 1]
            if len(some):
                for s in range(slices.shape[1]):
                    columns.setdefault(b + s, []).append(some[:, s] if sign > 0 else ~some[:, s])
    return added(columns, slices.shape[2]), const


def top(sums: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Positions of k rows with the largest sums; of equal ones, the first."""
    sure, maybe = np.zeros_like(valid), valid
    for s in reversed(sums):
        x = sure | maybe & s
        n = int(np.bitwise_count(x).sum())
        if n > k:
            maybe = maybe & s
        else:
            sure = x
            maybe = maybe & ~s
            if n == k:
                maybe = np.zeros_like(maybe)
                break
    chosen = _places(sure)
    return np.concatenate([chosen, _places(maybe)[:k - len(chosen)]])


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def read(sums: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.int64)
    for power, s in enumerate(sums):
        out += (s[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << power
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for every row of queries (vec_id and vec), against all rows of vectors."""
    spark = vectors.sparkSession
    take = lambda df: df.filter(F.col("vec_id").isNotNull() & ann.whole(F.col(vec))).select("vec_id", quantised(F.col(vec), scale).alias("v"))
    rows, asked = take(vectors), take(queries)
    n, dim, least, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).head()
    n_asked, asked_dim = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    dim = max(1, dim or 1, asked_dim or 1)
    least, most = min(0, least or 0), max(0, most or 0)
    bits = max(1, (most - least).bit_length())
    blocks, chunks = max(1, -(-n // ROWS)), max(1, -(-n_asked // QUERIES))

    def table(pdf_rows) -> np.ndarray:
        out = np.zeros((len(pdf_rows), dim), dtype=np.int64)
        for i, v in enumerate(pdf_rows):
            out[i, :len(v)] = v
        return out

    def index(pdf):
        own = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame([(int(own["block"].iloc[0]), own["vec_id"].to_numpy().tobytes(), packed(table(own["v"]) - least, bits).tobytes())], columns=["block", "ids", "slices"])

    def ask(pdf):
        return pd.DataFrame([(int(pdf["chunk"].iloc[0]), pdf["vec_id"].to_numpy().tobytes(), table(pdf["v"]).tobytes())], columns=["chunk", "names", "queries"])

    def run(left, right):
        out = []
        for r in left.itertuples(index=False):
            ids = np.frombuffer(r.ids, dtype=np.int64)
            slices = np.frombuffer(r.slices, dtype=np.uint64).reshape(dim, bits, -1)
            every = np.zeros(slices.shape[2] * 8, dtype=np.uint8)
            every[:-(-len(ids) // 8)] = np.packbits(np.ones(len(ids), dtype=bool), bitorder="little")
            every = every.view(np.uint64)
            for x in right.itertuples(index=False):
                for name, q in zip(np.frombuffer(x.names, dtype=np.int64), np.frombuffer(x.queries, dtype=np.int64).reshape(-1, dim)):
                    sums, const = scores(slices, q)
                    valid = every.copy()
                    for p in range(*np.searchsorted(ids, [name, name + 1])):
                        valid[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
                    at = top(sums, valid, k)
                    if not len(at):
                        continue
                    score = read(sums, at) - const + least * int(q.sum())
                    # an id that several rows have may fill places that others should have
                    while len(set(ids[at].tolist())) < len(at) and len(at) < int(np.bitwise_count(valid).sum()):
                        more = top(sums, valid, 2 * len(at))
                        at, score = more, read(sums, more) - const + least * int(q.sum())
                        if len(set(ids[at].tolist())) >= k:
                            break
                    out.append((name, ids[at].tobytes(), score.astype(np.float64).tobytes()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    spread = lambda count, name: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(name)
    built = common.stored(rows.select(spread(blocks, "block"), "*").groupBy("block").applyInPandas(index, "block int, ids binary, slices binary"), "slices")
    asking = asked.select(spread(chunks, "chunk"), "*").groupBy("chunk").applyInPandas(ask, "chunk int, names binary, queries binary")
    per = PART // QUERIES
    upto = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = built.select("block", upto(-(-chunks // per), "part"), "ids", "slices")
    right = asking.select(upto(blocks, "block"), F.floor(F.col("chunk") / per).cast("int").alias("part"), "names", "queries")
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, "query_id long, ids binary, scores binary")
    best = ann.merged(found, k, max(1, min(chunks, 2 * common.cores(spark))))
    return best.withColumn("score", F.col("score").cast("long"))

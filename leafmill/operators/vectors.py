"""Exact vector search: with built-in array functions, and for many queries in blocks with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import fingerprint


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Its length; 1 for a zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def stored_form(a: Column) -> Column:
    """Six decimals; null if any component isn't a finite number."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(a, lambda x: F.floor(x.cast("double") * 1e6 + 0.5) / 1e6))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_k(vectors: DataFrame, query: list[float], k: int = 30, vec: str = "embedding") -> DataFrame:
    """vec_id, score of the k most similar; four decimals. Each task keeps k rows; only those meet."""
    q = F.array(*map(F.lit, query))
    return vectors.select("vec_id", (F.floor(cosine(F.col(vec), q) * 1e4 + 0.5) / 1e4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def _matrix(column: pd.Series) -> np.ndarray:
    """One row for each vector; NaN for missing components and for lengths other than the most frequent one."""
    size = column.map(len, na_action="ignore").mode()
    size = int(size.iloc[0]) if len(size) else 0
    none = np.full(size, np.nan)
    return np.array([none if x is None or len(x) != size else np.asarray(x, dtype=np.float64) for x in column]).reshape(len(column), size)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As dot(), component by component, so that sums round alike."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    n = np.sqrt(_dots(a, a))
    return np.where(n == 0, 1.0, n)


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", block: int = 4096, chunk: int = 64) -> DataFrame:
    """query_id, vec_id, score, rank for queries that may grow with the table: blocks of queries meet blocks of vectors, and
    only the best k of each pair of blocks go on. Vectors are to have one length."""
    # the sizes alone reach the driver
    n_rows, n_asked = -(-vectors.count() // block) or 1, -(-queries.count() // block) or 1
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("vec_id", F.col(vec).alias("_v"), dealt(n_rows).alias("_i"), every(n_asked).alias("_j"))
    asked = queries.select(F.col("vec_id"), F.col(vec).alias("_v"), dealt(n_asked).alias("_j"), every(n_rows).alias("_i"))

    def run(own, given):
        out = []
        if len(own) and len(given):
            own = own.sort_values("vec_id", kind="stable")
            both = _matrix(pd.concat([own["_v"], given["_v"]]))
            x, q = both[:len(own)], both[len(own):]
            ids, names, xn, qn = own["vec_id"].to_numpy(), given["vec_id"].to_numpy(), _norms(x), _norms(q)
            for a in range(0, len(q), chunk):
                scores = np.floor(_dots(q[a:a + chunk, None, :], x[None, :, :]) / (qn[a:a + chunk, None] * xn) * 1e4 + 0.5) / 1e4
                for name, s in zip(names[a:a + chunk], scores):
                    other = np.flatnonzero(ids != name)
                    key = np.where(np.isnan(s[other]), -np.inf, s[other])
                    if len(other) > k:
                        near = key >= np.partition(key, len(key) - k)[len(key) - k]
                        other, key = other[near], key[near]
                    best = other[np.argsort(-key, kind="stable")[:k]]
                    out.append(pd.DataFrame({"query_id": name, "vec_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score"])

    found = rows.groupBy("_i", "_j").cogroup(asked.groupBy("_i", "_j")).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def semantic(docs: DataFrame, query: list[float], k: int = 30) -> tuple[DataFrame, DataFrame]:
    """(doc_id, similarity of the `k` nearest documents; one row that says how many have text, how many of those a fresh
    vector, and the mode).

    docs: doc_id, text, vector, made_of (the fingerprint of the text that the vector was made of; empty if unknown). Stored
    vectors count only if every document with text has a fresh one and all have the query's length and finite numbers;
    else new ones are to be made first, and nothing is found.
    """
    some = docs.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    own = F.coalesce(F.nullif(F.col("made_of"), F.lit("")), fingerprint(F.col("text")))
    fresh = F.coalesce(F.size("vector") > 0, F.lit(False)) & (own == fingerprint(F.col("text")))
    fits = fresh & (F.size("vector") == len(query)) & F.coalesce(stored_form(F.col("vector")).isNotNull(), F.lit(False))
    rows = some.select("doc_id", "vector", F.coalesce(fresh, F.lit(False)).alias("fresh"), F.coalesce(fits, F.lit(False)).alias("fits"))
    state = rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("fresh").alias("fresh"), F.count_if("fits").alias("fits"))  # one row
    state = state.withColumn("mode", F.when((F.col("fits") == F.col("candidates")) & (F.col("candidates") > 0), "cached").when(F.col("fresh") > 0, "mixed").otherwise("live"))
    usable = rows.select("doc_id", "vector").join(F.broadcast(state.filter("mode = 'cached'").select("mode"))).select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding"))
    return top_k(usable, query, k).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("similarity")), state

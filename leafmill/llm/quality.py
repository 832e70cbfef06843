"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its bytes and words and of its neighbours; the field labels each line good or bad; exact
forward-backward marginals, weighted by length, sum up to a document's share of bad text, which a logistic curve turns
into a score between 0 and 1. All feature work is numpy over blocks of bytes, with no loop over characters.

Fitting uses at most `sample` labelled documents of at most `lines` lines together (drawn by hash, so a sample at any size
of the corpus), never those held out, and only their text and label. Line labels are latent: all lines of a good document are good; of a bad one,
those that a first model finds bad.

Cases: null or empty texts are one empty line and are scored; rows that repeat a doc_id give a row each, and one of its
texts is learned from; a doc_id with several labels counts by one of them; without usable labels every score is 0.5;
extra columns may have any name; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

N_CLASSES = 9
CLASS = np.full(256, 0, dtype=np.uint8)  # 0: lower-case letters and all else
CLASS[65:91] = 1
CLASS[48:58] = 2
for _c in b"#$%&*@^~_=+<>{}[]\\/":
    CLASS[_c] = 3
CLASS[ord("|")] = 4
CLASS[ord("!")] = 5
for _c in b".,;:?'\"()-":
    CLASS[_c] = 6
for _c in b" \t\r\v\f\n":
    CLASS[_c] = 7
CLASS[128:] = 8
#: Capital letters of the Latin-1 block, by their second byte.
LATIN_CAPITAL = np.zeros(256, dtype=bool)
LATIN_CAPITAL[0x80:0x9f] = True

OWN, NEAR = 18, 6


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line; its length in bytes; and how many lines each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    lens = np.array([len(x) for x in texts], dtype=np.int64)
    text_end = np.cumsum(lens + 1) - 1
    lines = np.diff(np.concatenate([[0], np.searchsorted(end, text_end) + 1]))
    n = (end - start).astype(np.float64)
    size = np.maximum(n, 1)
    kind = CLASS[data]
    capital = np.concatenate([[False], (data[:-1] == 0xC3) & LATIN_CAPITAL[data[1:]]])

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (sums[end] - sums[start]).astype(np.float64)

    per = [count(kind == k) for k in range(N_CLASSES)]
    caps = per[1] + count(capital)
    letters = np.maximum(1, per[0] + per[1] + per[8] / 2)
    gap = kind == 7
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    w_start, w_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = common.Prefixes(data)
    names = word.of(w_start, w_end)
    text_of = np.searchsorted(text_end, w_start)
    same = np.zeros(len(names), dtype=bool)
    same[1:] = (names[1:] == names[:-1]) & (text_of[1:] == text_of[:-1])
    marked = np.isin(kind[np.maximum(w_end - 1, 0)], (3, 4, 5))

    def by_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[np.searchsorted(w_start, end)] - sums[np.searchsorted(w_start, start)]).astype(np.float64)

    words = by_line(np.ones(len(names), dtype=bool))
    some = np.maximum(1, words)
    owner = np.repeat(np.arange(len(texts)), lines)
    name = word.of(start, end) + owner.astype(U64) * U64(common.BASE)
    order = np.argsort(name, kind="stable")
    again = np.zeros(len(name))
    again[order[1:]] = name[order[1:]] == name[order[:-1]]
    again *= n > 0
    own = np.stack([
        np.ones(len(n)), caps / letters, per[2] / size, per[3] / size, per[4] / size, per[5] / size, per[6] / size,
        per[7] / size, per[8] / size, np.minimum(2, size / some / 10), np.log1p(n) / 8, by_line(same) / some,
        by_line(marked) / some, again, caps / letters > 0.5, per[3] / size > 0.04, per[4] / size > 0.02,
        by_line(same) / some > 0.3], axis=1)
    key = own[:, [1, 3, 4, 5, 11, 12]]
    first, last = np.cumsum(lines) - lines, np.cumsum(lines) - 1
    before, after = np.zeros_like(key), np.zeros_like(key)
    before[1:], after[:-1] = key[:-1], key[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after], axis=1), n, lines


WIDTH = OWN + 2 * NEAR


def forward_backward(score: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is bad, and expected transitions (2, 2) over all texts; score is the log-odds of bad
    of a line by itself. All texts step on together, the longest first."""
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    count = lines[order]
    longest = int(count[0]) if len(count) else 0
    live = [int(np.searchsorted(-count, -t, "left")) for t in range(longest)]  # texts with more than t lines
    e = np.exp(trans - trans.max())
    emit = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
    emit /= emit.sum(axis=1, keepdims=True)
    alpha = np.zeros_like(emit)
    for t in range(longest):
        at = first[:live[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ e) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(emit)
    moves = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[:live[t + 1]] + t
        ahead = emit[at + 1] * beta[at + 1]
        b = ahead @ e.T
        pair = alpha[at][:, :, None] * e[None] * ahead[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), moves


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def shares(bad: np.ndarray, n: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted share of bad text for each document."""
    weight = n + 1
    first = np.cumsum(lines) - lines
    return np.add.reduceat(bad * weight, first) / np.add.reduceat(weight, first) if len(lines) else np.zeros(0)


def fit(x: np.ndarray, n: np.ndarray, lines: np.ndarray, good: np.ndarray) -> dict[str, np.ndarray]:
    """good: each text's label. Returns what score() takes."""
    if not len(lines) or good.all() or not good.any():
        return {"w": np.zeros(WIDTH), "trans": np.zeros((2, 2)), "curve": np.zeros(2)}
    owner = np.repeat(np.arange(len(lines)), lines)
    y = (~good[owner]).astype(np.float64)
    weight = np.sqrt(n + 1)
    weight /= weight.mean()
    for side in (0, 1):
        weight[y == side] *= len(y) / 2 / max(1e-9, weight[y == side].sum())
    first = _adam(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) / len(y) + 1e-4 * w, np.zeros(WIDTH), 400, 0.1)
    p = _sigmoid(x @ first)
    begin = np.cumsum(lines) - lines
    most = np.maximum.reduceat(p, begin)[owner]
    y = ((y > 0) & ((p > 0.5) | (p == most))).astype(np.float64)
    inside = np.ones(len(y) - 1, dtype=bool)
    inside[begin[1:] - 1] = False
    a, b = y[:-1][inside].astype(int), y[1:][inside].astype(int)
    seen = np.bincount(a * 2 + b, minlength=4).reshape(2, 2).astype(np.float64)

    def grad(z: np.ndarray) -> np.ndarray:
        bad, moves = forward_backward(x @ z[:WIDTH], lines, z[WIDTH:].reshape(2, 2))
        return np.concatenate([x.T @ (bad - y) / len(y), (moves - seen).ravel() / len(y)]) + 1e-4 * z

    z = _adam(grad, np.concatenate([first, np.zeros(4)]), 120, 0.1)
    bad, _ = forward_backward(x @ z[:WIDTH], lines, z[WIDTH:].reshape(2, 2))
    m = _log_odds(shares(bad, n, lines))
    curve = _adam(lambda c: np.array([(r := _sigmoid(c[0] + c[1] * m) - good).mean(), (r * m).mean()]) + 1e-4 * c, np.zeros(2), 800, 0.05)
    return {"w": z[:WIDTH], "trans": z[WIDTH:].reshape(2, 2), "curve": curve}


def _log_odds(share: np.ndarray) -> np.ndarray:
    s = np.clip(share, 0.002, 0.998)
    return np.log(s / (1 - s))


def score(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    out = []
    for a, b in common.chunked(texts):
        x, n, lines = line_features(texts[a:b])
        bad, _ = forward_backward(x @ model["w"], lines, model["trans"])
        out.append(_sigmoid(model["curve"][0] + model["curve"][1] * _log_odds(shares(bad, n, lines))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = 3000, lines: int = 400_000, text: str = "text",
            label: str = "quality") -> dict[str, np.ndarray]:
    """A model from at most `sample` labelled documents that aren't held out: in the order of their ids' hashes, as many as
    have at most `lines` lines together. Their features, not texts, reach the driver, some 130 bytes a line."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).filter("id is not null and y is not null")
    drawn = usable.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    drawn = drawn.orderBy(F.xxhash64("id"), "id").limit(sample)
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("data"))
    own = own.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("data").alias("data"))
    own = own.withColumn("n_lines", F.length("data") - F.length(F.translate("data", "\n", "")) + 1).filter(F.col("n_lines") <= lines)

    def features(batches):
        for pdf in batches:
            if len(pdf):
                x, n, count = line_features([t.encode() for t in pdf["data"]])
                cut = np.cumsum(count)[:-1]
                yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "n_lines": count, "n": [v.tobytes() for v in np.split(n, cut)],
                                    "x": [v.astype(np.float32).tobytes() for v in np.split(x, cut)]})

    rows = common.stored(own.mapInPandas(features, "id long, y int, n_lines long, n binary, x binary"), "features")
    sizes = rows.select("id", "n_lines").orderBy(F.xxhash64("id"), "id").collect()  # at most `sample`
    total = np.cumsum([r["n_lines"] for r in sizes])
    taken = [r["id"] for r, t in zip(sizes, total) if t <= lines]
    got = sorted(rows.filter(F.col("id").isin(taken)).collect(), key=lambda r: r["id"]) if taken else []
    if not got:
        return fit(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
    n = [np.frombuffer(r["n"], dtype=np.float64) for r in got]
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in got]).astype(np.float64)
    return fit(x, np.concatenate(n), np.array([len(v) for v in n]), np.array([r["y"] == 1 for r in got]))


def scored(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, where it lies."""
    common.lean(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score(model, pdf["_t"].tolist())})

    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))
    return own.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def kept(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs that the model accepts, unchanged."""
    common.lean(docs.sparkSession)

    @F.pandas_udf("double")
    def of(data: pd.Series) -> pd.Series:
        out = pd.Series(score(model, data.tolist()))
        common.given_back()
        return out

    return docs.filter(of(F.coalesce(F.col(text), F.lit("")).cast("binary")) >= least)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2

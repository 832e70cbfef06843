"""Byte-level BPE: encode and decode in batches.

Words of a batch that are not known yet lie side by side in one flat numpy array of symbols. A round looks up every
neighbouring pair by binary search among the sorted pair keys, takes the lowest rank of each word and merges all its
occurrences; words that have no pair left drop out. Known words are kept in a bounded table for each Python worker.

Cases: null texts are empty and have no ids; a special token's string in a text is that token, as the tokenizers
library has it; other columns stay, whatever their names; the texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed value: how this kind of vocabulary splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of the first 256 characters, for Python's faster engine.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
#: Words that a worker keeps; beyond that it starts anew, which only costs time.
KEEP = 700_000


def _byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        size = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([size, *(i + 1 for i in self.special.values())])
        parts: list[bytes] = [b""] * size
        for token, i in vocab.items():
            parts[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            parts[i] = token.encode()
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.words, self.plain, self.odd = regex.compile(WORDS), re.compile(PLAIN), re.compile("[^\x00-\xff]")
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        none = len(self.made)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        syms = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(syms):
            rank = np.full(len(syms), none, dtype=np.int64)
            key = syms[:-1] << 32 | syms[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(syms)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < none, size)
            if not live.all():
                done.append((owner[~live], syms[~live]))
                rank, syms, owner, least, size = rank[live], syms[live], owner[live], least[least < none], size[least < none]
                if not len(syms):
                    break
            take = rank == np.repeat(least, size)
            # of pairs that overlap (a a a), the left one counts: within a run of neighbours every other one
            index = np.arange(len(take))
            fresh = take & ~np.concatenate([[False], take[:-1]])
            run = np.maximum.accumulate(np.where(fresh, index, -1))
            take &= (index - run) % 2 == 0
            syms[take] = self.made[rank[take]]
            stay = ~np.concatenate([[False], take[:-1]])
            syms, owner = syms[stay], owner[stay]
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, dtype=np.int64)
        flat = np.concatenate([s for _, s in done]) if done else np.zeros(0, dtype=np.int64)
        order = np.argsort(owners, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(owners, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Adds words that are not known yet."""
        n, at = len(words), len(self.known)
        flat, counts = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.count[at:at + n] = counts
        self.begin[at:at + n] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.known.update(zip(words, range(at, at + n)))

    def _special(self, i: int) -> int:
        """A special token as a known word."""
        name = f"\0{i}"
        if name not in self.known:
            self.learn([name])
            k = self.known[name]
            self.flat[self.begin[k]], self.count[k] = i, 1
        return self.known[name]

    def cut(self, text: str) -> list[str]:
        return (self.words if self.odd.search(text) else self.plain).findall(text)

    def pieces(self, text: str) -> list[tuple[str, list[str]]]:
        if self.split is None or not any(s in text for s in self.special):
            return [("", self.cut(text))]
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [("", self.cut(text[at:m.start()])), (m[0], [])]
            at = m.end()
        return [*out, ("", self.cut(text[at:]))]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEEP:
            self._clear()
        known = self.known
        cut = [self.pieces(t) for t in texts]
        used = set().union(*(words for parts in cut for _, words in parts))
        new = [w for w in used if w not in known]
        if new:
            self.learn(new)
        # a small table of this batch's words stays in the processor's cache
        local = dict(zip(used, map(known.__getitem__, used)))
        out = []
        for parts in cut:
            if len(parts) == 1:
                idx = np.fromiter(map(local.__getitem__, parts[0][1]), dtype=np.int64, count=len(parts[0][1]))
            else:
                idx = np.array([i for s, words in parts for i in ([self._special(self.special[s])] if s else map(local.__getitem__, words))], dtype=np.int64)
            counts = self.count[idx]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.begin[idx] - ends + counts, counts) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        counts = self.lengths[ids]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.starts[ids] - ends + counts, counts) + np.arange(total)]
        return data.tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """One for each worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _batches(pdf: pd.DataFrame, text: str, limit: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about `limit` characters."""
    size = pdf[text].str.len().to_numpy().cumsum()
    part = size // limit
    for i in np.unique(part):
        yield pdf[part == i]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array<int>); one row for each row, nothing moves between machines."""
    schema = docs.drop(ids).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        bpe = tokenizer(path)
        for pdf in batches:
            own = pdf.drop(columns=[ids], errors="ignore")
            found = bpe.encode_batch(own[text].fillna("").tolist())
            yield own.assign(**{ids: [x.astype(np.int32) for x in found]})

    return docs.mapInPandas(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """coded with a column of the text that its ids stand for; null ids give an empty text."""
    schema = coded.drop(text).schema.add(text, "string")

    def run(batches):
        bpe = tokenizer(path)
        for pdf in batches:
            own = pdf.drop(columns=[text], errors="ignore")
            yield own.assign(**{text: [bpe.decode(np.zeros(0, dtype=np.int64) if x is None else x) for x in own[ids]]})

    return coded.mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without the ids leaving the worker.

    Rows that repeat a doc_id each give a row of their own.
    """

    common.lean(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for whole in batches:
            for pdf in _batches(whole, "_t"):
                found = bpe.encode_batch(pdf["_t"].tolist())
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].to_numpy(), "n_tokens": [len(x) for x in found],
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found]})

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

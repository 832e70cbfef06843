"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over counts of pieces by length, of which there are at most `size` different ones, so planning costs
the same for any number of documents. Pieces then find their slot by their rank within their length.

Cases: a null or empty text is one piece that holds the end id alone; a document longer than `size` is cut into full
pieces and a last one; rows that repeat a doc_id are documents of their own, as are equal rows; documents of equal length
are told apart by doc_id, piece and checksum, and take their length's slots in any order beyond that; extra columns may
have any name and are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed value: how the lower-case word vocabulary splits a text.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which Python's own lower() and composition are the library's; a text with any other goes to the
#: library as a whole.
ODD = r"[^\t\n\r\x20-\x7e\xa1-\xff]"
GAP, LETTER, NUMBER, SIGN = 0, 1, 2, 3
KIND = np.full(256, SIGN, dtype=np.uint8)
for _c in map(chr, range(256)):
    KIND[ord(_c)] = LETTER if _c.isalpha() else NUMBER if _c.isnumeric() else GAP if _c in "\t\n\r " else SIGN
#: Words that a worker keeps; beyond that it starts anew, which only costs time.
KEEP = 500_000
END_ID = 1


class WordTokenizer:
    """Ids as the tokenizers library gives them. Equal words have equal ids, so each goes to the library once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"truncation": None, "padding": None}
        self.added = [t["content"] for t in spec["added_tokens"]]
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        rules = [x["pattern"]["Regex"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        #: Else every text goes to the library as a whole.
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and rules == [RULE]
        self.odd = re.compile(ODD)
        # for words that are normalised and cut already
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.single = Tokenizer.from_str(json.dumps(spec))
        self._clear()

    @functools.cached_property
    def whole(self):
        """For texts that aren't cut here; most workers never meet one."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def _clear(self) -> None:
        self.names, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        self.index, self.begin, self.count = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.letters, self.letters_begin, self.letters_end = np.zeros(0, dtype=np.uint8), *(np.zeros(0, dtype=np.int64) for _ in range(2))

    def _learn(self, names: np.ndarray, raw: list[bytes]) -> None:
        words = [x.decode("latin-1") for x in raw]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        begin = len(self.letters) + np.cumsum(sizes) - sizes
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(raw), dtype=np.uint8)])
        self.letters_begin, self.letters_end = np.concatenate([self.letters_begin, begin]), np.concatenate([self.letters_end, begin + sizes])
        # the library's results are large; a few thousand at a time
        found = [e.ids for i in range(0, len(words), 4096) for e in self.single.encode_batch(words[i:i + 4096], add_special_tokens=False)]
        counts = np.array([len(x) for x in found], dtype=np.int32)
        self.begin = np.concatenate([self.begin, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32)])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=counts.sum())])
        self.count = np.concatenate([self.count, counts])
        at = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, at, names)
        self.index = np.insert(self.index, at, np.arange(len(self.count) - len(words), len(self.count), dtype=np.int32))

    @staticmethod
    def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text of Latin-1 bytes, in lower case and with a gap at its end, start and end."""
        kind = KIND[data]
        before = np.concatenate([[GAP], kind[:-1]]).astype(np.uint8)
        start = (kind != GAP) & ((kind != before) | (kind == NUMBER))
        mark = np.flatnonzero((data == 39) & (before != SIGN))
        mark = mark[mark + 2 < len(data)]
        one, two = data[mark + 1], data[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[mark[short | long] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[long] + 3])
        after = after[after < len(data)]
        start[after] |= kind[after] == LETTER
        events = np.flatnonzero(start | (kind == GAP))
        first = np.flatnonzero(start[events])
        return events[first], events[first + 1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words are found by a 64-bit hash of their characters and length, and each is compared with the
        word that its hash stands for; one that differs goes to the library itself."""
        if len(self.count) > KEEP:
            self._clear()
        quick = [self.by_word and self.odd.search(t) is None and not any(s in t for s in self.added) for t in texts]
        raw = [t.lower().encode("latin-1") if q else b"" for t, q in zip(texts, quick)]
        whole = b"\n".join(raw) + b"\n"
        data = np.frombuffer(whole, dtype=np.uint8)
        start, end = self.cut(data)
        names = common.mixed(common.Prefixes(data).of(start, end) + (end - start).astype(np.uint64))
        used, first, which = np.unique(names, return_index=True, return_inverse=True)
        new = ~common.member(used, self.names)
        if new.any():
            at = first[new]
            self._learn(used[new], [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
        idx = self.index[np.searchsorted(self.names, used)]
        counts = self.count[idx][which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = self.flat[np.repeat(self.begin[idx][which] - ends[:-1], counts) + np.arange(ends[-1])]
        lens = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        edge = np.searchsorted(start, np.concatenate([[0], np.cumsum(lens)]))
        bounds = ends[edge]
        apart = set((np.searchsorted(edge, self._unlike(data, start, end, idx[which]), "right") - 1).tolist())
        return [flat[a:b] if q and i not in apart else np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                for i, (t, q, a, b) in enumerate(zip(texts, quick, bounds[:-1], bounds[1:]))]

    def _unlike(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """Which words aren't, byte for byte, those kept under their hash: two words of one hash."""
        size = end - start
        kept_size = self.letters_end[idx] - self.letters_begin[idx]
        bad = size != kept_size
        data, letters = np.append(data, np.zeros(8, dtype=np.uint8)), np.append(self.letters, np.zeros(8, dtype=np.uint8))
        mine = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        theirs = np.ndarray(shape=(len(letters) - 7,), dtype="<u8", buffer=letters, strides=(1,))
        left, a, b, at = size.copy(), start, self.letters_begin[idx], np.flatnonzero(~bad)
        left, a, b = left[at], a[at], b[at]
        while len(at):
            differ = mine[a] ^ theirs[b]
            short = left < 8
            differ[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            bad[at[differ != 0]] = True
            on = left > 8
            at, left, a, b = at[on], left[on] - 8, a[on] + 8, b[on] + 8
        return np.flatnonzero(bad)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, size: int = 4096, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, on wish) of every piece, cut where the documents lie."""
    common.lean(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        tok = tokenizer(path)
        for pdf in batches:
            lens = pdf["_t"].str.len().to_numpy().cumsum() // (1 << 19)
            for part in np.unique(lens):
                own = pdf[lens == part]
                rows = []
                for d, ids in zip(own["doc_id"].tolist(), tok.encode(own["_t"].tolist())):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), size)):
                        x = ids[s:s + size]
                        rows.append((d, p, s, len(x), zlib.crc32(x.tobytes()), *([x.astype(np.int32)] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))
            common.given_back()

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(run, schema)


def plan(counts: dict[int, int], size: int = 4096) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, number, first sequence, pieces in each sequence, offset).

    Sequences with the same room left are kept as runs, so a step places any number of pieces at once. A run of m
    sequences takes as many pieces each as fit; best fit would come back to the same sequence, whose room is then the
    tightest.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, number)
    out, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                each = size // length
                n = -(-left // each)
                free.setdefault(size, []).append((made, n))
                made, room = made + n, size
            first, n = free[room].pop()
            if not free[room]:
                del free[room]
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, size - room))
                free.setdefault(room - each * length, []).append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                out.append((length, rank, left, first + full, left, size - room))
                free.setdefault(room - left * length, []).append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                free.setdefault(room, []).append((first + full, n - full))
    return out


def pack(parts: DataFrame, size: int = 4096) -> DataFrame:
    """parts (doc_id, piece, length and more) with sequence_id and offset.

    What reaches the driver is a count for each length (at most `size`); the plan that goes back has at most a few rows
    for each pair of length and room, whatever the number of documents. Ranks are dealt over (length, salt), so that a
    frequent length isn't one task's.
    """
    spark = parts.sparkSession
    parts = stored_parts = common.stored(parts, "pieces")
    rows = stored_parts.groupBy("length").count().collect()
    steps = plan({r["length"]: r["count"] for r in rows}, size)
    salts = max(8, min(4096, sum(r["count"] for r in rows) // 100_000))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    each = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("_r", F.row_number().over(within) - 1).join(base, ["length", "_salt"])
              .withColumn("_rank", F.col("_r") + F.col("_base")).drop("_r", "_base", "_salt"))
    slots = spark.createDataFrame(
        pd.DataFrame(steps or None, columns=["_len", "_at", "_n", "_seq", "_each", "_off"]).astype("int64"),
        "_len long, _at long, _n long, _seq long, _each long, _off long")
    on = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_at")) & (F.col("_rank") < F.col("_at") + F.col("_n"))
    nth = F.col("_rank") - F.col("_at")
    joined = ranked.join(F.broadcast(slots) if len(steps) <= 200_000 else slots, on)
    return joined.withColumns({
        "sequence_id": F.col("_seq") + F.floor(nth / F.col("_each")),
        "offset": F.col("_off") + (nth % F.col("_each")) * F.col("length"),
    }).drop("_rank", "_len", "_at", "_n", "_seq", "_each", "_off")


def packed(docs: DataFrame, path: str, size: int = 4096, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document, with its place."""
    return pack(pieces(docs, path, size, text, with_ids), size)

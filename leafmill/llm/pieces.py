"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

No token holds a space mark after another character, so a text falls into units (space marks and what follows up to the
next one) that are encoded apart; known units are kept in a bounded table for each Python worker. In a unit an
Aho-Corasick pass finds the longest token that starts at each place. From the left the longest one is taken that is
compatible with its left neighbour: the two, written together and merged again, fall into the same two. Where no token
fits, the place is marked in a field of failed positions and the last token gives way to the next shorter one. A row of
tokens of which all neighbours are compatible is the one that merging makes, so a position fails once and for all.

Cases: null texts are empty; an empty text has the begin and end ids only; special tokens' strings in a text are plain
text; a space mark in a text is a space, as the library has it; characters outside the vocabulary become bytes; other
columns stay, whatever their names; rows that repeat an id each have a row; an empty table gives none; texts are never cut.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

SPACE = "▁"
#: Units, ids of units, and pairs of neighbours that a worker keeps; beyond that it starts anew, which only costs time.
KEEP, KEEP_IDS, KEEP_PAIRS = 700_000, 8_000_000, 1_000_000
#: Shown for the unknown id in a decoded text. Fixed value.
UNKNOWN = " ⁇ "

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))  # a byte that is no part of a character stands alone


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ  ÅＡ x "
        if model.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("the model rewrites texts before it cuts them")
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no ids for bytes")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter = self._shorter()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        held = set("".join(self.ids))
        # characters of no token part their neighbours; of these, line ends are frequent
        alone = "".join(c for c in "\n\r\t\v\f" if c not in held)
        apart = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")) if apart else re.compile("(?s:.+)")
        parts = [b""] * len(ids)
        for piece, i in self.ids.items():
            parts[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            parts[i] = bytes([b])
        if model.unk_id() >= 0:
            parts[model.unk_id()] = UNKNOWN.encode()
        self.spaced = np.zeros(len(parts), dtype=bool)
        self.spaced[[i for piece, i in self.ids.items() if piece.startswith(SPACE)]] = True
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.known: dict[str, int] = {}
        self._clear()

    def _shorter(self) -> dict[str, str | None]:
        """The longest token (or single character) that starts each token and is shorter."""
        out = {}
        for piece in self.ids:
            n = len(piece) - 1
            while n > 1 and piece[:n] not in self.ids:
                n -= 1
            out[piece] = piece[:n] or None
        return out

    def _clear(self) -> None:
        self.known.clear()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.first, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def merged(self, text: str) -> list[str]:
        """The text's tokens by merging: of all neighbours that make a token the best, the leftmost of equals, each time."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, last: str, token: str) -> bool:
        """Whether merging leaves the two as they are; with no last one, the token alone."""
        found = self.pairs.get((last, token))
        if found is None:
            if len(self.pairs) > KEEP_PAIRS:
                self.pairs.clear()
            found = self.pairs[last, token] = self.merged(last + token) == ([last, token] if last else [token])
        return found

    def backtracked(self, unit: str) -> list[str]:
        n, known, shorter = len(unit), self.pairs.get, self.shorter.get
        longest = [1] * n
        for end, size in self.automaton.iter(unit):  # of one start the longer ones end later
            longest[end - size + 1] = size
        failed = bytearray(n + 1)
        out: list[str] = []
        at, last, token = 0, "", unit[:longest[0]]
        while True:
            while token:
                to = at + len(token)
                if not failed[to] and (known((last, token)) or self.fits(last, token)):
                    break
                token = shorter(token)
            if token:
                out.append(token)
                if to == n:
                    return out
                at, last, token = to, token, unit[to:to + longest[to]]
            else:
                failed[at] = 1
                gone = out.pop()
                at -= len(gone)
                last, token = out[-1] if out else "", shorter(gone)

    def learn(self, units: list[str]) -> None:
        """Adds units that are not known yet."""
        ids, counts, known, letters = [], [], self.ids.get, self.bytes.__getitem__
        for unit in units:
            tokens = self.backtracked(unit)
            own = list(map(known, tokens))
            if None in own:
                own = [i for token, found in zip(tokens, own) for i in ([found] if found is not None else map(letters, token.encode("utf-8", "surrogatepass")))]
            ids += own
            counts.append(len(own))
        n, at = len(units), len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[at:at + n] = counts
        self.first[at:at + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(units, range(at, at + n)))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the begin and end ids."""
        if len(self.known) > KEEP or self.used > KEEP_IDS:
            self._clear()
        cut = [self.units.findall((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        used = set().union(*cut)
        self.learn([u for u in used if u not in self.known])
        local = dict(zip(used, map(self.known.__getitem__, used)))  # of this batch: small enough for the processor's cache
        out = []
        for units in cut:
            idx = np.fromiter(map(local.__getitem__, units), dtype=np.int64, count=len(units))
            counts = self.count[idx]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            ids = np.empty(total + 2, dtype=np.uint32)
            ids[0], ids[-1] = self.begin, self.end
            ids[1:-1] = self.flat[np.repeat(self.first[idx] - ends + counts, counts) + np.arange(total)]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        counts = self.lengths[ids]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        data = self.data[np.repeat(self.starts[ids] - ends + counts, counts) + np.arange(total)]
        shown = ids[counts > 0]
        if len(shown) and self.spaced[shown[0]]:  # the space that encoding has put in front
            data = data[1:]
        return data.tobytes().decode("utf-8", "each_byte")


_LOADED: dict[str, Pieces] = {}


def tokenizer(path: str) -> Pieces:
    """One for each worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array<int>); one row for each row, nothing moves between machines."""
    schema = docs.drop(ids).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        own = tokenizer(path)
        for pdf in batches:
            found = own.encode_batch(pdf[text].fillna("").tolist())
            yield pdf.drop(columns=[ids], errors="ignore").assign(**{ids: [x.astype(np.int32) for x in found]})

    return docs.mapInPandas(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """coded with a column of the text that its ids stand for; null ids give an empty text."""
    schema = coded.drop(text).schema.add(text, "string")

    def run(batches):
        own = tokenizer(path)
        for pdf in batches:
            yield pdf.drop(columns=[text], errors="ignore").assign(**{text: [own.decode(np.zeros(0, dtype=np.int64) if x is None else x) for x in pdf[ids]]})

    return coded.mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without the ids leaving the worker."""
    common.lean(docs.sparkSession)

    def run(batches):
        own = tokenizer(path)
        for whole in batches:
            for pdf in bpe._batches(whole, "_t"):
                found = own.encode_batch(pdf["_t"].tolist())
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].to_numpy(), "n_tokens": [len(x) for x in found],
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in found]})

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

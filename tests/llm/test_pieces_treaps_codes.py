"""SentencePiece ids against the library, treap search and vector codes against brute force, and the cases that each defines."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from leafmill.llm import codes, pieces, queries, treaps

MODEL = queries.vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string, extra string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made(library, texts):
    return [library.encode(t, add_bos=True, add_eos=True) for t in texts]


# --- SentencePiece ---


def test_ids_are_those_of_the_library(library):
    rnd, own = random.Random(3), pieces.tokenizer(MODEL)
    texts = ["", " ", "▁", "a▁b", "a\0b", "<s> </s> <unk> <0x0A>", "\r\n\t", "x\n y", "ﬁ Ａ é 　x", "👩‍👩‍👧 日本語 テスト", *(" " * k for k in range(70)), *(" " * k + "word" for k in range(40))]
    for alphabet in ("ab", "aab ", "ations er", "\n \t\rab", "éñßthe 日本,.;"):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    names = list(own.ids)
    texts += ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 6))) for _ in range(3000)]
    found = own.encode_batch(texts)
    assert [x.tolist() for x in found] == made(library, texts)
    assert [own.decode(x) for x in found] == [library.decode(x) for x in made(library, texts)]


def test_any_ids_decode_as_in_the_library(library):
    rnd, own = random.Random(4), pieces.tokenizer(MODEL)
    for _ in range(500):
        ids = [rnd.randrange(0, 300) if rnd.random() < 0.7 else rnd.randrange(32000) for _ in range(rnd.randint(0, 12))]
        assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids)


def test_long_texts_without_spaces(library):
    rnd, own = random.Random(5), pieces.tokenizer(MODEL)
    texts = ["".join(rnd.choice("thaeinrosl") for _ in range(1_100_000)), "a" * 50_000, "\n" * 2000]
    assert [x.tolist() for x in own.encode_batch(texts)] == made(library, texts)


def test_forgetting_changes_nothing(library, monkeypatch):
    own = pieces.Pieces(MODEL)
    monkeypatch.setattr(pieces, "KEEP", 3)
    monkeypatch.setattr(pieces, "KEEP_PAIRS", 2)
    for _ in range(3):
        texts = ["some words here", "and other words there", "some words"]
        assert [x.tolist() for x in own.encode_batch(texts)] == made(library, texts)


def test_round_trip_of_rows(spark, library):
    rows = [(1, "One  two\nthree", "e"), (2, None, "e"), (2, "", "e"), (3, "same", "e"), (3, "same", "e"), (None, "▁x", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("n_tokens", "_t", "decoded_sha256")})
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.round_trip(docs, MODEL).collect()), key=str) == sorted(want, key=str)
    assert pieces.round_trip(docs.limit(0), MODEL).count() == 0


def test_ids_and_texts_as_columns(spark, library):
    docs = spark.createDataFrame([(1, "One two", "e"), (2, None, "e")], DOCS)
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL).orderBy("doc_id").collect()
    assert [(r["ids"], r["decoded"], r["extra"]) for r in back] == [(library.encode("One two", add_bos=True, add_eos=True), "One two", "e"), ([1, 2], "", "e")]


# --- treaps ---

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return SPLIT.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def best(docs, items, k):
    """(item, rank, doc, score) of all, from the definition."""
    counts = [(i, Counter(cut(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for item, own in asked.items():
        rows = []
        for (doc, c), size in zip(counts, sizes):
            m = 75 + 25 * size * n // total if total else 0
            score = sum(w * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, w in own.items() if t in c)
            if score > 0:
                rows.append((-score, doc is not None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def texts(rnd, n, words="the of and Word été 日本 x1 X1 rare-one seldom".split()):
    for _ in range(n):
        yield " ".join(rnd.choice(words[:rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 30)))


@pytest.mark.parametrize("shard,part", [(8192, 256), (7, 2)])
def test_search_is_brute_force(spark, monkeypatch, shard, part):
    monkeypatch.setattr(treaps, "SHARD", shard)
    monkeypatch.setattr(treaps, "PART", part)
    rnd = random.Random(6)
    docs = [(i, t) for i, t in enumerate(texts(rnd, 60))] + [(5, "the rare"), (5, "the rare"), (None, "seldom rare"), (70, None), (71, ""), (72, "-- ,,")]
    items = [(i, t) for i, t in enumerate(texts(rnd, 9))] + [(None, "rare seldom"), (20, None), (21, "nowhere"), (3, "one one rare")]
    given = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS).withColumn("term", F.lit("mine")).repartition(9)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    got = treaps.ranked(given, asked, 5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(best(docs, items, 5), key=str)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], DOCS)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treaps.ranked(docs.limit(0), items, 5).count() == 0
    assert treaps.ranked(docs, items.limit(0), 5).count() == 0
    assert treaps.ranked(docs, items.withColumn("text", F.lit("none of these")), 5).count() == 0


def test_search_of_a_long_text(spark):
    rnd = random.Random(7)
    docs = [(1, " ".join(rnd.choice("abcdefgh") for _ in range(600_000))), (2, "a b"), (3, "c")]
    items = [(1, "a b zz"), (2, " ".join(["c"] * 1000))]
    got = treaps.ranked(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted(map(tuple, got.collect())) == sorted(best(docs, items, 20))


def grown(rnd, n_docs, n_terms, impacts):
    rows = sorted({(rnd.randrange(n_terms), rnd.randrange(n_docs)) for _ in range(n_docs * 3)})
    rnd.shuffle(rows)
    term, doc = (np.array(x, dtype=np.int64) for x in zip(*rows))
    return term, doc, np.array([rnd.randint(1, impacts) for _ in rows], dtype=np.int64)


@pytest.mark.parametrize("impacts", [1, 3, 1000])
def test_treaps_are_search_trees_and_heaps(impacts):
    rnd = random.Random(impacts)
    t = treaps.Treaps(300, *grown(rnd, 300, 5, impacts))
    seen = []

    def down(at, low, high, depth):
        if at < 0:
            return 0
        assert low <= t.doc[at] < high
        for child in (t.left[at], t.right[at]):
            assert child < 0 or t.impact[child] <= t.impact[at] and t.term[child] == t.term[at]
        seen.append(at)
        return 1 + max(down(t.left[at], low, t.doc[at], depth + 1), down(t.right[at], t.doc[at] + 1, high, depth + 1))

    depths = [down(root, 0, 300, 0) for root in t.root[1]]
    assert sorted(seen) == list(range(len(t.term))) and max(depths) < 40


@pytest.mark.parametrize("leaf,step", [(1, 1), (1, 64), (5, 3), (64, 64)])
def test_traversals_find_the_best(monkeypatch, leaf, step):
    monkeypatch.setattr(treaps, "LEAF", leaf)
    monkeypatch.setattr(treaps, "STEP", step)
    rnd = random.Random(leaf * 100 + step)
    for _ in range(25):
        n = rnd.choice((1, 9, 200))
        term, doc, impact = grown(rnd, n, 6, rnd.choice((2, 500)))
        ids = np.array(rnd.sample(range(1000), n), dtype=np.int64)
        own = np.array(sorted(rnd.sample(range(8), rnd.randint(1, 8))), dtype=np.int64)
        weight = np.array([rnd.randint(0, 9) for _ in own], dtype=np.int64)
        score = np.zeros(n, dtype=np.int64)
        for t, d, i in zip(term, doc, impact):
            score[d] += i * weight[own == t].sum()
        want = [(d, s) for s, _, d in sorted((-s, ids[d], d) for d, s in enumerate(score) if s > 0)[:4]]
        shard = treaps.Treaps(n, term, doc, impact)
        for least in {0, max([0, *(-s for _, s in want[3:])])}:
            docs, found = shard.best(own, weight, 4, least, ids)
            order = np.lexsort((ids[docs], -found))
            assert list(zip(docs[order], -found[order])) == want


def test_weak_subtrees_are_not_visited(monkeypatch):
    monkeypatch.setattr(treaps, "LEAF", 1)
    rnd = np.random.default_rng(1)
    doc = np.tile(np.arange(5000), 3)
    impact = rnd.integers(1, 100, 15000)
    impact[::100] += 900
    t = treaps.Treaps(5000, np.repeat(np.arange(3), 5000), doc, impact)
    looked, scored = [], t.scored
    t.scored = lambda low, high, *rest: looked.append((high - low).sum()) or scored(low, high, *rest)
    t.best(np.arange(3), np.ones(3, dtype=np.int64), 10, 0, np.arange(5000))
    assert sum(looked) < 1500


# --- vector codes ---


def compressed(rows, parts, entries, rounds, scale):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in kept) // parts)
    x = np.zeros((len(kept), parts * width), dtype=object)
    for i, r in enumerate(kept):
        x[i, :len(r[1])] = [math.floor(scale * v) for v in r[1]]
    x = x.reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i].ravel().tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()

    def near():
        far = [((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return [[min(range(len(first)), key=lambda e: (f[i, e], e)) for i in range(len(kept))] for f in far], far

    for _ in range(rounds):
        at, _ = near()
        for p in range(parts):
            for e in range(len(first)):
                own = [x[i, p] for i in range(len(kept)) if at[p][i] == e]
                if own:
                    books[p, e] = [sum(c) // len(own) for c in zip(*own)]
    at, far = near()
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    error = [sum(far[p][i, at[p][i]] for p in range(parts)) for i in range(len(kept))]
    by = Counter()
    for r, e in zip(kept, error):
        by[r[2]] += e
    return [(r[0], "".join(f"{at[p][i]:02x}" for p in range(parts)), error[i], by[r[2]], digest) for i, r in enumerate(kept)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, tree string, n long"


def given(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", 7) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("grain", [0.5, 0.004])
def test_codes_are_brute_force(spark, grain):
    rnd = np.random.default_rng(8)
    rows = [(i, (np.round(rnd.normal(size=12) / grain) * grain).tolist(), int(rnd.integers(4)) if i % 5 else None) for i in range(150)]
    rows += [(7, rows[7][1], 1), (7, [0.0] * 12, 1), (None, [1.0] * 12, None), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 12, 2), (203, [float("inf")] * 12, 2), (204, [1.5, -2.25], 2), (205, [], 2)]
    got = codes.compressed(given(spark, rows), parts=4, entries=9, rounds=2, scale=8)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(compressed(rows, 4, 9, 2, 8), key=str)


def test_codes_of_few_and_of_equal_rows(spark):
    for rows in ([(1, [1.0, 2.0, 3.0], 1)], [(i, [1.0, 2.0], 0) for i in range(40)]):
        got = codes.compressed(given(spark, rows), parts=2, entries=64, rounds=2, scale=256)
        assert sorted(map(tuple, got.collect())) == sorted(compressed(rows, 2, 64, 2, 256))
    assert codes.compressed(given(spark, [(1, None, 1)]), parts=2).count() == 0
    with pytest.raises(ValueError, match="below"):
        codes.compressed(given(spark, [(1, [1e30], 1)]), parts=1)


@pytest.mark.parametrize("spread", [2, 300])
def test_trees_assign_and_sum_as_all_pairs_do(spread, monkeypatch):
    monkeypatch.setattr(codes, "TABLE", 4096)
    rnd = np.random.default_rng(spread)
    for _ in range(20):
        n, d, k = int(rnd.integers(1, 500)), int(rnd.integers(1, 5)), int(rnd.integers(1, 65))
        points = rnd.integers(-spread, spread + 1, size=(n, d))
        book = points[rnd.integers(0, n, size=k)] + rnd.integers(0, 2, size=(k, d))
        tree = codes.Tree.restored(codes.Tree(points).pickled())
        far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        entry, error = tree.assigned(book)
        assert (entry == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        total, count = tree.sums(book)
        assert all(count[j] == (entry == j).sum() and (total[j] == points[entry == j].sum(axis=0)).all() for j in range(k))


def test_near_points_are_assigned_by_whole_subtrees():
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-10_000, 10_000, size=(16, 4))
    tree = codes.Tree(centres[rnd.integers(0, 16, 4000)] + rnd.integers(-20, 20, size=(4000, 4)))
    alone = sum(len(at) for at, _, far in tree.walk(centres) if far is not None)
    assert alone < 400

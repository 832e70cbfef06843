"""Cases that every operator defines: hash traps, clashing names, nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from leafmill.llm import ann, bitslice, bpe, chat, common, jaccard, packing, quality, queries, secrets, suffix, urls

WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = """_d _t _had _k _g _s row digest kept found id none text_ block data rep n_copies size grams tokens node component name at least
starts ends spans live hash which first bundle cell i j side lo hi _n length piece sequence_id offset score predicted held_out""".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], COLUMNS)


def crowded(df):
    """df with a column of every clashing name."""
    return df.select("*", *(F.lit(f"mine {n}").alias(n) for n in CLASHING))


def thue_morse(n):
    x = [0]
    while len(x) < n:
        x += [1 - b for b in x]
    return "".join("ab"[b] for b in x[:n]), "".join("ba"[b] for b in x[:n])


# --- words and strings of equal sums modulo a power of two ---


def test_sums_tell_thue_morse_words_apart():
    a, b = (x.encode() for x in thue_morse(2048))
    names = common.Prefixes(np.frombuffer(a + b + a, dtype=np.uint8)).of(np.array([0, 2048, 4096]), np.array([2048, 4096, 6144]))
    assert names[0] == names[2] != names[1]


def test_thue_morse_documents_are_no_copies(spark):
    a, b = thue_morse(2048)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.linked(docs_of(spark, [(1, a, "s"), (2, b, "s"), (3, a.upper(), "s")]), count=True).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_thue_morse_words_have_their_own_ids():
    a, b = thue_morse(2048)
    ref, tok = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD)
    assert [x.tolist() for x in tok.encode([a, b, f"{b} {a}"])] == [ref.encode(t, add_special_tokens=False).ids for t in (a, b, f"{b} {a}")]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Even if every word had one hash, the ids would be the library's."""
    monkeypatch.setattr(common, "mixed", lambda x: np.ones_like(x))
    ref, tok = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD)
    texts = ["same same", "other words, here", "same", "", "sam same eightchar ninechars1"]
    assert [x.tolist() for x in tok.encode(texts)] == [ref.encode(t, add_special_tokens=False).ids for t in texts]


def test_thue_morse_strings_stay(spark):
    a, b = thue_morse(2048)
    rows = [(1, "1 " + a[:900] + " x", "s"), (2, "2 " + b[:900] + " y", "s")]
    want = list(removed([t.encode() for _, t, _ in rows], 700))
    got = {r["doc_id"]: r["n_removed"] for r in suffix.report(docs_of(spark, rows), 700).collect()}
    assert [got[1], got[2]] == [n for n, _ in want]


# --- suffixes ---


def removed(texts, n):
    seen = Counter(b[i:i + n] for b in texts for i in range(len(b) - n + 1))
    for b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        yield int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize("length", [14, 25, 60, 250, 400])
def test_order_of_suffixes(length):
    rnd = random.Random(length)
    for trial in range(20):
        base = "".join(rnd.choice("ab" if trial % 2 else "abcdefgh ") for _ in range(3 * length)) if trial % 5 else "a" * 3 * length
        strings = []
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randrange(0, len(base) - length + 1)
            s = base[a:min(len(base), a + length + rnd.randint(0, 40))]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(s))
                s = s[:k] + "Z" + s[k + 1:]
            strings.append(s.encode())
        strings = list(dict.fromkeys(strings))
        every = [s[i:i + length] for s in strings for i in range(len(s) - length + 1)]
        order = {x: k for k, x in enumerate(sorted(set(every)))}
        rank = suffix.Sorted(strings, length).rank
        assert np.unique(rank, return_inverse=True)[1].tolist() == [order[x] for x in every]


def test_hash_ties_alone_remove_nothing(spark, monkeypatch):
    """Steps one and two may let anything through; the sort decides by bytes."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdef ") for _ in range(700)) for _ in range(5)]
    texts += [texts[0][:500] + "!", "?" + texts[1][100:620], "a" * 1500, "b" * 900 + "c"]
    monkeypatch.setattr(suffix, "KEYS", 50)
    monkeypatch.setattr(suffix, "BUCKET", 500)
    monkeypatch.setattr(suffix, "CUT", 100)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix.report(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), 400).collect()}
    assert got == {i: (n, hashlib.sha256(k).hexdigest()) for i, (n, k) in enumerate(removed([t.encode() for t in texts], 400))}


def test_every_name_may_tie(monkeypatch):
    """With one name for all, cover places and windows are all candidates, and only true ties come out."""
    part = suffix.Part([b"x" * 100 + b"y" * 100, b"z" * 150], 60)
    at = part.suffixes(5, part.samples(5)[0])
    assert at.tolist() == [*range(141), *range(201, 201 + 91)]
    made = part.strings(at)
    assert sum(n for _, n, _ in made) == len(at) and all(n <= suffix.CUT for _, n, _ in made)


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 100, 500):
        assert suffix.sliding_least(x, width).tolist() == [int(x[i:i + width].min()) for i in range(len(x) - width + 1)]


def test_suffixes_of_odd_rows(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(1_200_000))
    rows = [(1, None, "s"), (2, "", "s"), (3, "q" * 399, "s"), (4, long, None), (4, long, "s"), (5, "é" * 300, "s"), (5, "é" * 300 + "!", "s"), (None, "r" * 500, "s")]
    given = docs_of(spark, rows)
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.report(crowded(given), 400).collect()))
    assert got == sorted([(0, 500, 500, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 399, 0, 0), (4, 1_200_000, 1_200_000, 1), (4, 1_200_000, 1_200_000, 1), (5, 600, 600, 1), (5, 601, 600, 1)])


# --- clashing names, repeated rows and nulls, operator by operator ---

ODD = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "One two three four five six", None), (3, None, "b"), (3, "", "b"), (None, "one two three four five six", "c"), (5, "alone here", "d"), (5, "and here", "d")]


def test_one_of_each_keeps_columns_and_one_row(spark):
    got = jaccard.one_of_each(crowded(docs_of(spark, ODD)))
    assert got.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), *CLASHING]
    rows = got.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted([(1, ODD[0][1]), (3, ""), (5, "alone here"), (5, "and here")])
    assert all(r[n] == f"mine {n}" for r in rows for n in CLASHING)


def test_deduplicated_keeps_columns(spark):
    same = "".join(chr(97 + i * i % 26) for i in range(450))
    got = suffix.deduplicated(crowded(docs_of(spark, [(1, same + "x", "s"), (2, "y" + same, "s"), (3, None, "s"), (4, "z", "s"), (5, "w" * 450, "s"), (6, "w" * 450, "s")])), 400)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {d: r["text"] for d, r in rows.items()} == {1: "x", 2: "y", 3: None, 4: "z", 5: "", 6: ""}
    assert all(r[n] == f"mine {n}" for r in rows.values() for n in CLASHING)
    few = suffix.deduplicated(docs_of(spark, [(5, "w" * 450, "s"), (6, "w" * 450, "s"), (7, "", "s")]), 400, drop_emptied=True)
    assert [r["doc_id"] for r in few.collect()] == [7]


def test_redacted_keeps_columns(spark):
    got = secrets.redacted(crowded(docs_of(spark, [(1, "password=Zx81kLm99Qa", "s"), (1, "password=Zx81kLm99Qa", "s"), (2, None, None)])))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "[SECRET]"), (1, "[SECRET]"), (2, None)]
    assert all(r[n] == f"mine {n}" for r in got.collect() for n in CLASHING)


def test_packing_of_odd_rows(spark):
    given = [*ODD, (9, "word " * 30_000, "s")]
    got = packing.packed(crowded(docs_of(spark, given)), WORD, 4096).toPandas()
    ref, want = Tokenizer.from_file(WORD), Counter()
    for d, t, _ in given:
        ids = ref.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((d or 0, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((0 if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]


def test_round_trip_of_odd_rows(spark):
    given = [*ODD, (9, "word\n" * 220_000, "s")]
    got = Counter((r["doc_id"] or 0, r["n_tokens"], r["decoded_sha256"]) for r in bpe.round_trip(crowded(docs_of(spark, given)), BYTE).collect())
    ref = Tokenizer.from_file(BYTE)
    assert got == Counter((d or 0, len(ref.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in given)
    assert bpe.round_trip(docs_of(spark, ODD).limit(0), BYTE).count() == 0


def test_links_of_odd_rows(spark):
    given = crowded(docs_of(spark, ODD))
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.linked(given, count=True).collect())
    assert got == sorted([(1, 2, 1, 3), (1, 2, 1, 3), (2, 2, 1, 3), (0, 2, 1, 3), (3, 0, 3, 0), (3, 0, 3, 0), (5, 1, 5, 0), (5, 1, 5, 0)])


@pytest.mark.parametrize("weight", [32 << 20, 200, 1])
def test_heavy_groups_are_cut_by_bytes(spark, weight, monkeypatch):
    monkeypatch.setattr(jaccard, "WEIGHT", weight)
    lengths = [20, 21, 22, 24, 28, 30, 36, 40]
    rows = [(i, " ".join(f"w{k}" for k in range(n)), "s") for i, n in enumerate(lengths)]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.linked(docs_of(spark, rows), count=True).collect()}
    sets = [n - 4 for n in lengths]
    links = [sum(i != j and 5 * min(a, b) >= 4 * max(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert {i: got[i][1] for i in got} == dict(enumerate(links)) and {c for c, _ in got.values()} == {0}


# --- vectors ---


def test_hot_cells_are_cut_on_both_sides(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 8))
    x[:120] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 20 = 0")
    whole = sorted(tuple(r) for r in ann.nearest(rows, asked, 20).collect())
    monkeypatch.setattr(ann, "CELL", 16)
    monkeypatch.setattr(ann, "ASKED", 3)
    monkeypatch.setattr(ann, "ROWS", 16)  # many pairs of blocks
    assert sorted(tuple(r) for r in ann.nearest(rows, asked, 20).collect()) == whole
    first = [r for r in whole if r[0] == 0]
    assert [r[2] for r in first] == list(range(1, 21)) and len({r[3] for r in first}) == 1


def test_unlike_lengths_have_bands_of_their_own(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(600, 16))
    x *= 10.0 ** rnd.integers(-1, 2, size=(600, 1))
    x[7] *= 1e6
    x[8] *= 1e-200
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, rows.filter("vec_id % 20 = 0 OR vec_id IN (7, 8)"), 20).toPandas()
    share = []
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        share.append(len(set(np.argsort(-s)[:20]) & set(g["vec_id"])) / 20)
    assert len(share) == 32 and np.mean(share) >= 0.9 and min(share) >= 0.6


def test_the_share_of_rows_that_is_reached_falls(spark):
    rnd = np.random.default_rng(5)
    frame = lambda n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(n, 32)))], "vec_id long, embedding array<double>")
    small, large = ((lambda r: ann.reach(r, r.filter("vec_id < 20"), 20))(frame(n)) for n in (500, 4000))
    assert 0 < large < 0.75 * small


def test_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [3.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0], "x"), (4, [], "x"), (5, None, "x"), (None, [9.0, 0.0], "x"), (6, [1.0, float("-inf")], "x")]
    given = crowded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, own string"))
    near = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(given, given.filter("vec_id = 2"), 20).collect()}
    assert near == {(2, 1, 1, 6.0)}
    top = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.top_k(given, given.filter("vec_id = 2"), 10, scale=1).collect()}
    assert top == {(2, 1, 1, 6), (2, 2, 3, 0), (2, 3, 4, 0)}


@pytest.mark.parametrize("part", [4096, 64])
def test_parts_of_queries(spark, part, monkeypatch):
    x = np.random.default_rng(5).integers(-9, 9, size=(260, 5))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(bitslice, "PART", part)
    monkeypatch.setattr(bitslice, "ROWS", 100)
    got = defaultdict(list)
    for r in bitslice.top_k(rows, rows, 3, scale=1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(260):
        s = x @ x[q]
        assert got[q] == [(int(i), int(s[i])) for i in np.lexsort((np.arange(260), -s)) if i != q][:3]


# --- ownership, by brute force ---


def test_ownership_counts(spark):
    rnd = random.Random(7)
    values = [f"password=Secret{i}value" for i in range(12)] + [f"Ab{i}" + "cD3" * 8 for i in range(6)]
    rows = []
    for i in range(150):
        some = rnd.sample(values, rnd.randint(0, 3))
        rows.append((i, " and ".join(some), rnd.choice(["a", "b", "c", "d", None]) if i % 3 else "a"))
    rows += [(500, rows[0][1], "z"), (0, rows[0][1], rows[0][2])]
    owners, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for v in t.split(" and "):
            owners[v].add(s)
            texts[v].add(t)
    got = secrets.scanned(docs_of(spark, rows), copied_in=15)
    n = 0
    for r in got.collect():
        t = next(t for d, t, _ in rows if d == r["doc_id"])
        for s in r["found"]:
            v = t[s["start"]:s["end"]]
            assert (s["n_docs"], s["n_owners"], s["live"]) == (len(texts[v]), len(owners[v]), len(owners[v]) < 3 and len(texts[v]) < 15), v
            n += 1
    assert n > 100 and got.count() == len(rows)


def test_own_kind_is_kept_where_it_is_live(spark):
    key = "aB3dE5gH7jK9mN1pQ3sT5"
    rows = [(1, f"see {key} here", "a"), *((i, f"{i} sample xY9zW8vU7tS6rQ5pO4nM3", f"o{i}") for i in range(2, 7))]
    got = {r["doc_id"]: r for r in secrets.scanned(docs_of(spark, rows)).select("doc_id", secrets.written(secrets.all_spans(F.col("found"))).alias("s"), secrets.verdicts(F.col("found")).alias("v")).collect()}
    assert got[1]["s"] == "key:4:25" and got[1]["v"] == "key:4:25:1:1:live"
    assert got[2]["s"] == "" and got[2]["v"] == "key:9:30:5:5:copied"


def test_a_text_full_of_secrets(spark):
    text = " ".join(f"token={i:08d}abcdef" for i in range(3000))
    got = secrets.scanned(docs_of(spark, [(1, text, "a")])).head()["found"]
    assert len(got) == 3000 and [s["start"] for s in got[:2]] == [0, 21] and all(s["live"] for s in got)


# --- quality ---


def test_line_features():
    texts = ["AB 12#\nplain words plain words\n\nAB 12#", "", "x|!\n"]
    x, n, lines = quality.line_features([t.encode() for t in texts])
    assert lines.tolist() == [4, 1, 2] and n.tolist() == [6, 23, 0, 6, 0, 3, 0]
    first = x[0]
    assert (first[1], first[2], first[3], first[7]) == (1.0, 2 / 6, 1 / 6, 1 / 6)
    again = x[:, 13]
    assert again.tolist() == [0, 0, 0, 1, 0, 0, 0]
    near = quality.OWN
    assert (x[1, near:near + 6] == x[0, [1, 3, 4, 5, 11, 12]]).all() and not x[0, near:near + 6].any()
    assert (x[2, near + 6:] == x[3, [1, 3, 4, 5, 11, 12]]).all() and not x[3, near + 6:].any()


def test_score_is_the_weighted_share():
    model = {"w": np.random.default_rng(1).normal(size=quality.WIDTH), "trans": np.array([[0.3, -0.2], [0.1, 0.4]]), "curve": np.array([0.5, -1.5])}
    text = b"Good line here.\n$$$ %%%\nOTHER"
    x, n, lines = quality.line_features([text])
    e, total = x @ model["w"], np.zeros(2)
    bad = np.zeros(3)
    for m in range(8):
        y = [m >> k & 1 for k in range(3)]
        w = np.exp(sum(np.clip(e[k], -30, 30) * y[k] for k in range(3)) + sum(model["trans"][y[k], y[k + 1]] for k in range(2)))
        total[0] += w
        bad += w * np.array(y)
    share = np.clip(((bad / total[0]) * (n + 1)).sum() / (n + 1).sum(), 0.002, 0.998)
    want = 1 / (1 + np.exp(-(0.5 - 1.5 * np.log(share / (1 - share)))))
    assert np.allclose(quality.score(model, [text]), [want])


def test_the_sample_is_bounded_by_lines(spark):
    texts = [("Fine line of words.\n" * (1 + i % 4) if i % 2 else "### $$$ ***\n" * (1 + i % 4)) for i in range(60)]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(1, "repeated id", "s"), (70, "x\n" * 5000, "s"), (None, "no id", "s")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (70, 0, 0), (71, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda x, n, lines, good: seen.append((len(n), len(lines))) or fit(x, n, lines, good)
        quality.trained(crowded(docs), crowded(labels).drop("score"), lines=40)
        quality.trained(docs, labels, sample=7)
    finally:
        quality.fit = fit
    assert 20 < seen[0][0] <= 40 and seen[1][1] <= 7


def test_quality_of_odd_rows(spark):
    model = {"w": np.ones(quality.WIDTH), "trans": np.zeros((2, 2)), "curve": np.array([0.0, -1.0])}
    given = crowded(docs_of(spark, [*ODD, (9, "long line " * 120_000, "s"), (10, "x\n" * 200_000, "s")]))
    got = quality.scored(given, model)
    assert got.count() == len(ODD) + 2 and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert [r["score"] for r in got.filter("doc_id = 1").collect()][0] == [r["score"] for r in got.filter("doc_id = 1").collect()][1]
    assert quality.kept(given, model, least=-1).columns == given.columns


# --- what an operator needs names of no columns but its own ---


def test_conversations_and_pages_of_odd_rows(spark):
    turns = crowded(spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "hi"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string"))
    out = chat.formatted(turns).select("conv_id", F.size(chat.parse(F.col("formatted"))).alias("n")).collect()
    assert sorted((r["conv_id"] or 0, r["n"]) for r in out) == [(0, 1), (1, 3)]
    pages = crowded(spark.createDataFrame([(1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (None, None)], "page_id long, url string"))
    rules = [urls.site_rule("block", "com/en/")]
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in urls.judged(pages, rules).collect()) == [(0, "allow"), (1, "block"), (1, "block")]


# --- the pipeline's stages ---


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rnd = random.Random(11)
    said = [("Good words in a line here.\n" * rnd.randint(1, 3)) + f"end {i}" if i % 2 else f"$$$ ### *** {i}\n" * 3 for i in range(80)]
    spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), [(1000 + i, t, "s") for i, t in enumerate(said)]


def test_stages_take_odd_rows(spark, labelled):
    where, more = labelled
    docs = crowded(docs_of(spark, [*ODD, *more])).withColumn("n_chars", F.col("n_chars"))
    for name, stage in p.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, where)
            assert got.columns == docs.columns, name
            rows = got.collect()
            assert all(r[n] == f"mine {n}" for r in rows for n in CLASHING), name
            assert not given.isEmpty() or not rows, name
    packed = p.pack(spark, docs, where)
    assert packed.select("doc_id", "piece").count() == len(ODD) + len(more) and p.pack(spark, docs.limit(0), where).count() == 0


def test_stages_do_what_they_say(spark, labelled):
    where, more = labelled
    rnd = random.Random(5)
    sentence = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"word{i:02d}"[:4] for i in range(60))
    assert len(passage.split()) > 50 and 250 < len(passage) < 400
    base = sentence(80)
    rows = [(1, base, "s"), (2, base, "s"), (3, base + " more", "s"), (4, sentence(40) + " " + passage + " " + sentence(40), "s"), (5, sentence(30) + " " + passage + " " + sentence(50), "t"),
            (6, sentence(60) + " password=Zx81kLm99Qa", "s"), (7, sentence(60), "u"), (8, None, "s"), (9, "", "s")]
    docs = docs_of(spark, rows)
    one = p.one_of_each_group(spark, docs, where)
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 4, 5, 6, 7, 8, 9]
    cut = {r["doc_id"]: r for r in p.cut_repeats(spark, one, where).collect()}
    assert sorted(cut) == [1, 4, 5, 6, 7, 8, 9] and passage[1:-1] not in cut[4]["text"] and passage[1:-1] not in cut[5]["text"]
    before = {d: t for d, t, _ in rows}
    assert all(cut[d]["text"] == before[d] for d in (1, 6, 7, 8, 9)) and len(cut[4]["text"].split()) >= 79  # the blanks beside the passage go with it
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values() if r["text"] is not None)
    hidden = {r["doc_id"]: r["text"] for r in p.hide_secrets(spark, one, where).collect()}
    assert hidden[6].endswith(" [SECRET]") and all(hidden[d] == before[d] for d in (1, 4, 5, 7, 8, 9))
    kept = {r["doc_id"] for r in p.accept_quality(spark, docs_of(spark, more), where).collect()}
    assert kept and all(d % 2 for d in kept) and len(kept) >= 30


def test_what_steps_leave_can_be_cleared(spark):
    docs = docs_of(spark, [(i, "same words " * 60 + str(i), "s") for i in range(4)])
    still_open = jaccard.linked(docs, count=True)
    with common.made() as own:
        got = common.stored(suffix.deduplicated(docs, 250), "result")
        texts = {n for k, n in own if k == "table"}
        assert texts and texts <= {t.name for t in spark.catalog.listTables()}
        common.cleared(spark, own, keep=got)
        assert len(own) == 1
    assert not texts & {t.name for t in spark.catalog.listTables()} and got.count() == 4
    assert still_open.count() == 4  # what it reads was made by another call
    common.cleared(spark, own)
    with pytest.raises(Exception, match="(?i)not.?exist|no such file|not found"):
        got.collect()


def test_a_pipeline_leaves_other_results_alone(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdef") * 3 for _ in range(90)), "s") for i in range(12)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = suffix.report(docs_of(spark, rows), 250)
    p.run(spark, str(tmp_path)).count()
    assert seen.count() == 12


def test_a_text_in_a_third_of_all_rows_is_cut_where_it_lies(spark):
    passage = " ".join(f"w{i}" for i in range(100))
    rows = [(i, "", "s") for i in range(40)] + [(100 + i, passage, "s") for i in range(40)] + [(200, passage + " tail", "s"), (201, None, "s"), (202, "short", "s"), (203, "short", "s"), (204, "alone " * 3, "s")]
    got = {r["doc_id"]: r["text"] for r in suffix.deduplicated(docs_of(spark, rows), 250).collect()}
    assert len(got) == len(rows) and all(got[i] == "" for i in range(40)) and all(got[100 + i] == "" for i in range(40))
    assert (got[200], got[201], got[202], got[203], got[204]) == (" tail", None, "short", "short", "alone " * 3)
    plan = suffix.deduplicated(docs_of(spark, rows), 250, drop_emptied=True)
    assert {r["doc_id"] for r in plan.collect()} == {*range(40), 200, 201, 202, 203, 204}

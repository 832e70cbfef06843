"""Each operator against brute force, and on nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import ann, bitslice, bpe, chat, common, jaccard, packing, quality, queries, secrets, suffix, urls

WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [words(rnd, rnd.choice((3, 40, 150, 400))) for _ in range(40)]
    out = base + base[:6]
    for t in base[:12]:
        w = t.split()
        for k in range(0, len(w), rnd.choice((15, 40, 90))):
            w[k] = "changed"
        out.append(" ".join(w))
    shared = words(rnd, 120)
    out += [words(rnd, 30) + " " + shared + " " + words(rnd, 20) for _ in range(5)] + [shared + " " + shared]
    return [*out, None, "", "   ", "One two", "ONE  TWO", "é" * 300 + shared, "x" * 900]


# --- n-gram Jaccard join ---


def sets(texts, n=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        yield {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(texts):
    s = list(sets(texts))
    root = list(range(len(s)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(len(x), top(i)) for i, x in enumerate(s)]


@pytest.mark.parametrize("tile", [4096, 3])
def test_jaccard_classes(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = by_id(jaccard.linked(documents(spark, texts)))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == classes(texts)


def test_jaccard_keeps_one(spark, texts):
    kept = {r["doc_id"] for r in jaccard.one_of_each(documents(spark, texts)).collect()}
    assert kept == {c for _, c in classes(texts)}


def test_jaccard_of_nothing_and_of_repeated_rows(spark):
    assert jaccard.linked(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (4, None, 0)], "doc_id long, text string, digest int")
    got = sorted((tuple(r) for r in jaccard.linked(rows).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)], key=str)


def test_tile_links_make_the_same_classes():
    rnd = random.Random(1)
    pool = np.sort(np.array([rnd.getrandbits(64) for _ in range(60)], dtype=np.uint64))
    arrays = [np.unique(np.delete(pool, rnd.sample(range(60), rnd.randint(0, 9)))) for _ in range(40)]
    links = jaccard.tile_links(np.arange(40), np.zeros(40, dtype=int), arrays, 4, 5)
    for a, b in links:
        x, y = set(arrays[a]), set(arrays[b])
        assert len(x & y) * 5 >= 4 * len(x | y)


# --- suffix-array dedup ---


def removed(texts, n):
    seen = Counter(b[i:i + n] for b in texts for i in range(len(b) - n + 1))
    for b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        yield int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize("n", [400, 60])
def test_suffixes(spark, texts, n):
    got = by_id(suffix.report(documents(spark, texts), n))
    for i, (gone, spans, kept) in enumerate(removed([(t or "").encode() for t in texts], n)):
        assert tuple(got[i])[1:] == (len((texts[i] or "").encode()), gone, spans, hashlib.sha256(kept).hexdigest()), i


def test_deduplicated_texts_keep_their_columns(spark, texts):
    docs = documents(spark, texts).withColumn("kept", F.lit(7)).withColumn("digest", F.lit("mine"))
    got = by_id(suffix.deduplicated(docs, 400))
    assert got[0].asDict().keys() == set(docs.columns) and len(got) == len(texts)
    for i, (_, _, kept) in enumerate(removed([(t or "").encode() for t in texts], 400)):
        assert (got[i]["text"] or "") == kept.decode("utf-8", "ignore")


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_covers(q):
    v, d = suffix.cover(q)
    assert v == q * q + q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


def test_suffixes_of_nothing(spark):
    assert suffix.report(spark.createDataFrame([], DOCS)).count() == 0


# --- packing and tokens ---

ODD = ["", "'s", "''s", "I'REALLY 'llx", "<|endoftext|>", "é́ 日本 😀\x00", "a" * 3000, "\x1c a\x1fb", "ΣΑΣ İ", "1234 ٣٤", "a\xa0b", "  x \n\n y  "]


def test_word_ids_are_the_librarys():
    rnd = random.Random(2)
    many = ODD + ["".join(rnd.choice("astrevmld'' .,12²ßÀé\n\"") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    tok, ref = packing.WordTokenizer(WORD), Tokenizer.from_file(WORD)
    assert [x.tolist() for x in tok.encode(many)] == [e.ids for e in ref.encode_batch(many, add_special_tokens=False)]


def test_byte_ids_are_the_librarys():
    rnd = random.Random(3)
    many = ODD + ["".join(rnd.choice("ab 'sltre\n\t1é日") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    tok, ref = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    want = [e.ids for e in ref.encode_batch(many, add_special_tokens=False)]
    assert [x.tolist() for x in tok.encode_batch(many)] == want
    assert [tok.decode(x) for x in want] == [ref.decode(x, skip_special_tokens=False) for x in want]
    assert tok.decode(np.array([255, 100])) == ref.decode([255, 100], skip_special_tokens=False)


def test_round_trip(spark):
    got = by_id(bpe.round_trip(documents(spark, [*ODD, None]), BYTE))
    ref = Tokenizer.from_file(BYTE)
    for i, t in enumerate([*ODD, ""]):
        ids = ref.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.decode(bpe.encode(documents(spark, ["hi there", None]), BYTE), BYTE).filter("decoded = coalesce(text, '')").count() == 2


@pytest.mark.parametrize("size", [4096, 16])
def test_packing(spark, texts, size):
    got = packing.packed(documents(spark, texts), WORD, size).toPandas()
    ref = Tokenizer.from_file(WORD)
    want = []
    for i, t in enumerate(texts):
        ids = ref.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, p, s, len(ids[s:s + size]), zlib.crc32(np.array(ids[s:s + size], dtype="<u4").tobytes())) for p, s in enumerate(range(0, len(ids), size))]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all() and g["length"].sum() <= size
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // size) * 1.05 + 1


def test_plan_packs_full():
    for counts in ({10: 3, 6: 1, 4: 5, 3: 7}, {16: 2}, {1: 40}, {9: 5, 7: 5}, {}):
        room = Counter()
        for length, _, n, first, each, off in packing.plan(counts, 16):
            for i in range(n):
                room[first + i // each] += length
        assert all(v <= 16 for v in room.values()) and sum(room.values()) == sum(k * v for k, v in counts.items())


def test_packing_nothing(spark):
    assert packing.packed(spark.createDataFrame([], DOCS), WORD).count() == 0


# --- chat ---


def test_chat_reads_back(spark):
    said = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>\\x<|end|>\n", "\\", "", None, "<|more|>\\<|", "plain"]
    rows = [(c, t, r, said[(c + t) % len(said)], 0) for c in range(7) for t, r in enumerate(["system", "user", "user", "assistant", "assistant", "<|role\n\\", None])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    out = chat.formatted(turns)
    got = out.select("conv_id", chat.parse(F.col("formatted")).alias("p"), chat.loss_text(F.col("segments")).alias("loss"), "formatted").collect()
    for r in got:
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [tuple(x) for x in r["p"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    assert chat.formatted(turns.limit(0)).count() == 0


# --- URLs ---


def test_urls(spark):
    given = ["http://A.Example.com/en/71?x", "https://m.x.net/de/8", "http://example.net/de/80#y", "http://evilnet/de/1", "org/es/1", None, "x://ORG/es/#q", "http://cheap-pills.example.org/fr/", "http://badexample.com/en/7", "http://", "http://com/en"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    rules = [urls.site_rule(*r) for r in queries.SITE_RULES] + [urls.word_rule("block", w) for w in urls.SPAM_LABELS]
    got = by_id(urls.judged(pages, rules), "page_id")
    want = [("a.example.com", "/en/71", "example.com/en/7", "allow"), ("m.x.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/80", "example.net/de/8", "block"),
            ("evilnet", "/de/1", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/es/", "org/es/", "block"),
            ("cheap-pills.example.org", "/fr/", None, "block"), ("badexample.com", "/en/7", "com/en/", "block"), ("", "", None, "allow"), ("com", "/en", None, "allow")]
    assert [tuple(got[i])[1:5] for i in range(len(given))] == want
    assert urls.judged(pages.limit(0), rules).count() == 0


# --- secrets ---

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark):
    rnd = random.Random(4)
    bits = ["token", " = ", "\"", "password", ":", "AKIA", "ABCDEFGHIJ1234567890", "deadbeef" * 4, "é😀", " ", "Secret", "api_key", "'", "abc", "=", "A1b2C3d4E5f6G7h8I9j0K1", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(300)] + [None, "", "password=token:abcdefgh"]
    got = by_id(secrets.scanned(documents(spark, texts)))
    for i, t in enumerate(texts):
        assert [(s["start"], s["order"], s["kind"], s["end"]) for s in got[i]["found"] if s["kind"] != "key"] == base(t or ""), t


def test_copied_examples_stay_and_live_ones_go(spark):
    live, example = "password=Zx81kLm99Qa", "token: example0example"
    docs = documents(spark, [f"a {example} b", f"c {example} {live}", f"{example}", "clean", None, f"é{live}!"], lambda i: "one" if i in (1, 5) else f"s{i}")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(docs.withColumn("found", F.lit(1))).collect()}
    assert got == {0: f"a {example} b", 1: f"c {example} [SECRET]", 2: example, 3: "clean", 4: None, 5: "é[SECRET]!"}
    assert secrets.scanned(docs.limit(0)).count() == 0


# --- vector searches ---


def vectors(spark, n=400, dim=16, seed=6):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [None] + [1.0] * (dim - 1), 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [float("inf")] * dim, 0), (None, [1.0] * dim, 0)]
    return x.astype(np.float64), spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cell int")


def test_nearest(spark):
    x, rows = vectors(spark)
    got = ann.nearest(rows, rows.filter("vec_id % 20 = 0"), 20).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.array_equal(g["score"], s[g["vec_id"]])
        hits.append(len(set(want) & set(g["vec_id"])) / 20)
    assert len(hits) == 20 and np.mean(hits) >= 0.9


def test_nearest_of_few_gives_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPREAD", 0.01)  # one cell: what it doesn't give is searched among all
    x, rows = vectors(spark)
    few = rows.filter("vec_id < 7")
    assert ann.nearest(few, few.filter("vec_id = 0"), 20, tables=1).count() == 6
    assert ann.nearest(few.limit(0), few.limit(0), 20).count() == 0


@pytest.mark.parametrize("block", [32768, 70])
def test_bit_slices(spark, block, monkeypatch):
    monkeypatch.setattr(bitslice, "ROWS", block)
    x, rows = vectors(spark)
    z = np.floor(1024 * np.vstack([x, np.zeros((2, x.shape[1]))])).astype(np.int64)
    got = bitslice.top_k(rows, rows.filter("vec_id % 100 = 0 or vec_id = 51"), 10).toPandas()
    ids = np.append(np.arange(len(x)), len(x) + 1)  # the zero vector takes part here
    z = z[:-1]
    for q, g in got.groupby("query_id"):
        s = z @ z[list(ids).index(q)]
        s[list(ids).index(q)] = -(1 << 60)
        want = np.lexsort((ids, -s))[:10]
        g = g.sort_values("rank")
        assert g["vec_id"].tolist() == ids[want].tolist() and g["score"].tolist() == s[want].tolist()
    assert bitslice.top_k(rows.limit(0), rows.limit(0), 10).count() == 0


# --- quality ---


def test_quality_learns_and_holds_out(spark):
    rnd = random.Random(8)
    good = lambda: "\n".join(words(rnd, 12).capitalize() + "." for _ in range(rnd.randint(1, 8)))
    bad = lambda: "\n".join(" ".join(w + rnd.choice(("***", "$$$", "###")) for w in words(rnd, 10).split()) for _ in range(rnd.randint(1, 8)))
    texts = [good() if i % 3 else bad() for i in range(240)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    model = quality.trained(docs, labels)
    got = by_id(quality.scored(docs, model))
    held = [i for i in range(240) if got[i]["held_out"]]
    assert held == [i for i in range(240) if quality.is_held_out(i)]
    assert np.mean([got[i]["predicted"] == bool(i % 3) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 242
    assert quality.scored(docs, quality.trained(docs, labels.limit(0))).filter("score <> 0.5").count() == 0
    assert quality.scored(docs.limit(0), model).count() == 0
    assert quality.kept(docs, model).columns == docs.columns


def test_marginals_are_exact():
    rnd = np.random.default_rng(0)
    score, trans, lines = rnd.normal(size=9), rnd.normal(size=(2, 2)), np.array([4, 1, 4])
    got, _ = quality.forward_backward(score, lines, trans)
    at = 0
    for n in lines:
        total = np.zeros((n, 2))
        for m in range(2**n):
            y = [m >> k & 1 for k in range(n)]
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total[np.arange(n), y] += w
        assert np.allclose(got[at:at + n], total[:, 1] / total.sum(axis=1))
        at += n


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert all(got[x] == top(x) for e in edges if e[0] != e[1] for x in e)


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2), (9, 10), (1, 1)])
def test_bands_of_similar_sizes_meet(spark, num, den):
    pairs = spark.range(1, 20001).select(F.col("id").alias("a"), F.floor(F.col("id") * den / num).alias("b"))
    apart = jaccard.band(F.col("b"), num, den) - jaccard.band(F.col("a"), num, den)
    assert pairs.filter(apart > 1).count() == 0


@pytest.mark.parametrize("tile", [4096, 2, 1])
def test_chains_across_bands(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    lengths = [9, 10, 11, 12, 16, 20, 24, 28, 40, 52, 64, 100, 101, 140, 170]
    docs = spark.createDataFrame([(100 - i, " ".join(f"w{k}" for k in range(n)), None, "s", None) for i, n in enumerate(lengths)], DOCS)
    sets = {100 - i: n - 4 for i, n in enumerate(lengths)}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if 100 * min(sets[a], sets[b]) >= 80 * max(sets[a], sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(docs).collect()}
    assert got == {d: (sets[d], label[d]) for d in sets}

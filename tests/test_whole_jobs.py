"""Queries that cover whole tables and whole texts, against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.functions import text as tx
from leafmill.operators import enrich, organise, search, vectors


def run(spark, tmp_path, name, **tables):
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return entry.queries()[name](spark, str(tmp_path)).collect()


def md5(x):
    return hashlib.md5("|".join(x).encode()).hexdigest()


# --- phrases and tags of whole texts ---

ENDS = r"^[\s\-_:;,.()\[\]{}]+|[\s\-_:;,.()\[\]{}]+$"


def forms(words):
    return [p for p in (re.sub(ENDS, "", w.lower()) for w in words) if p]


def first(x, n):
    return list(dict.fromkeys(x))[:n]


def apart(words, n=20):
    kept = []
    for p in forms(words):
        if len(kept) < n and not any(p in k or k in p for k in kept):
            kept.append(p)
    return kept


@pytest.fixture(scope="module")
def long_texts(spark):
    same = " ".join(["Tape", "(in)", "ape,"] * 20)
    texts = [same + " quorum, Zebra.", same + " größe\tÉTÉ\n--", "é", "", None, " ".join(f"{chr(97 + i % 26)}{i}q" for i in range(300)), "kurz; und KURZ"]
    return spark.createDataFrame([(i, t, None if i == 6 else "de", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_phrases_of_whole_texts(spark, tmp_path, long_texts):
    got = {r["doc_id"]: r["phrases_md5"] for r in run(spark, tmp_path, "U06_phrases_apart", documents=long_texts)}
    assert got == {r["doc_id"]: md5(apart((r["text"] or "").split())) for r in long_texts.collect()}
    assert got[0] == md5(["tape", "in", "quorum", "zebra"])


def test_tags_of_whole_texts(spark, tmp_path, long_texts):
    got = {r["doc_id"]: (r["titles_md5"], r["keywords_md5"]) for r in run(spark, tmp_path, "T19_enriched_tags", documents=long_texts)}
    want = {}
    for r in long_texts.collect():
        w, lang = (r["text"] or "").split(), r["lang"] or ""
        keys, nouns = first(forms(w), 20), first(forms(w[19:]), 16)
        want[r["doc_id"]] = md5(first(forms([r["source"], lang]) + keys[:4], 14)), md5(first(keys + forms([lang, "x"]) + nouns[:6], 32))
    assert got == want


# --- tags and postings of every language ---


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(1, "the than the", "en"), (2, "entre oren Größe", "de"), (3, "reth reth", None), (4, "oren", "fr"), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_tags_of_every_language(spark, tmp_path, languages):
    got = {(r["doc_id"], r["tag"], r["score_milli"], r["rank"]) for r in run(spark, tmp_path, "T04_keyword_tags", documents=languages)}
    assert got == {(1, "the", 20000, 1), (1, "than", 15999, 2), (2, "entre", 16000, 1), (2, "oren", 15999, 2), (3, "reth", 20000, 1), (4, "oren", 16000, 1)}


def test_postings_of_every_language(spark, tmp_path, languages):
    got = {(r["token"], r["doc_id"], r["doc_len"], r["tf"]) for r in run(spark, tmp_path, "X07_postings", documents=languages)}
    assert got == {("the", 1, 3, 2), ("than", 1, 3, 1), ("entre", 2, 4, 1), ("oren", 2, 4, 1), ("gr", 2, 4, 1), ("e", 2, 4, 1), ("reth", 3, 2, 2), ("oren", 4, 1, 1)}


def test_postings_are_counted_where_they_lie(spark, tmp_path):
    """Only where ids repeat do counts meet."""
    rows = [(1, "b a b", "en", "s", 5), (2, "b  a\u00e9 7", "de", "s", 7), (3, "", "fr", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*rows, (1, "a c b", "en", "s", 5)], schema).write.parquet(f"{tmp_path}/again/documents.parquet")
    for name in ("X07_postings", "X07_field_postings"):
        own = entry.queries()[name](spark, str(tmp_path))
        assert "hashpartitioning" not in own._jdf.queryExecution().executedPlan().toString()
    count = lambda at, field: {(r["token"], r["doc_id"]): r["tf"] for r in entry.queries()["X07_field_postings"](spark, at).filter(F.col("field") == field).collect()}
    want = {("a", 1): 1, ("b", 1): 2, ("b", 2): 1, ("a", 2): 1, ("7", 2): 1}
    assert count(str(tmp_path), "text") == count(str(tmp_path), "clean_text") == want
    assert count(str(tmp_path), "file_name") == {(w, i): 1 for i in (1, 2, 3) for w in ("s", str(i), "txt")}
    again = entry.queries()["X07_postings"](spark, f"{tmp_path}/again").collect()
    assert {(r["token"], r["doc_id"]): r["tf"] for r in again} == {**want, ("a", 1): 2, ("b", 1): 3, ("c", 1): 1}
    assert len(again) == 6


# --- search with every fiftieth row ---


def round_cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    size = lambda x: math.sqrt(dot(x, x)) or 1.0
    return math.floor(dot(a, b) / (size(a) * size(b)) * 1e4 + 0.5) / 1e4


def test_every_fiftieth_row_is_a_query(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(260)]
    rows[100] = (100, [0.0] * 4, 1)
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = run(spark, tmp_path, "V02_knn", embeddings=given)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert {r[0] for r in found} == {0, 50, 100, 150, 200, 250} and len(found) == 6 * 30
    for q in (0, 50, 100):
        near = sorted(((-round_cosine(rows[q][1], v), i) for i, v, _ in rows if i != q))[:30]
        assert [(r[2], r[3]) for r in found if r[0] == q] == [(i, -s) for s, i in near]
    cut = vectors.knn_blocks(given, given.filter("vec_id % 50 = 0"), 30, block=4, chunk=2).collect()
    assert found == sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cut)
    assert {r["query_id"] for r in run(spark, tmp_path, "W06_precision_recall_at_k", embeddings=given)} == {0, 50, 100, 150, 200, 250}


# --- key phrases of documents ---


def keyphrases(text, known=("reth", "thing", "oren", "eran")):
    def plausible(w):
        w = w.replace("-", "")
        return 4 <= len(w) <= 18 and re.search("[aeiou]", w) and not re.search("[bcdfghjklmnpqrstvwxyz]{5,}|[aeiou]{4,}", w)

    words = [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s-]", " ", (text or "").lower()))
             if 3 <= len(w) <= 24 and w != "was" and not re.search("[0-9]", w) and (w in known or plausible(w))]
    runs = [tuple(words[i:i + n]) for n in (3, 2, 1) for i in range(len(words) - n + 1)]
    runs = [r for r in runs if len(r) == 1 or set(r) & set(known)]
    number, at = Counter(runs), {}
    for i, r in enumerate(runs):
        at.setdefault(r, i)
    score = lambda r: number[r] * (len(r) * 3 if len(r) > 1 else 1) + 2 / (1 + at[r] / 80) + 2 * sum(w in known for w in r)
    return apart([p for p in (" ".join(r) for r in sorted(number, key=lambda r: (-score(r), at[r]))) if len(p) <= 60])


def test_keyphrases_of_documents(spark, tmp_path):
    rnd = random.Random(4)
    pool = "reth thing oren eran barok selim tavon größe was quomedan ritual-oven zzz ab 12".split()
    texts = [" ".join(rnd.choice(pool) for _ in range(n)) for n in (0, 1, 2, 30, 400, 5000)] + [None, "Thing, Oren! thing oren; ünder"]
    given = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["keyphrases"] for r in run(spark, tmp_path, "T21_keyphrases", documents=given)}
    assert got == {i: "|".join(keyphrases(t)) for i, t in enumerate(texts)}


# --- markup with numeric entities ---


def test_markup_of_every_page(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>a&#65;b</p>"), (2, "<b>x&#x42;&amp;</b>"), (3, "plain"), (4, None)], "page_id long, html string")
    want = {1: "aAb", 2: "xB&", 3: "plain"}
    got = {r["page_id"]: r["text_md5"] for r in run(spark, tmp_path, "S11_markup_text", pages=pages)}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()} | {4: None}


def test_titles_of_one_shown_score_keep_the_order_of_lines(spark, tmp_path):
    lines = {0: "Quech ouenre par étreviré enai èèpaque çchque le ére dans leoiment de du.", 1: "Éenai leletre anque enmenttion. Du de éaiê. Èê le de éeaution éenè.",
             4: "Éai les, oution. Èle ouchan èment enanè mentou queoition oiou. Le."}
    docs = spark.createDataFrame([(1, "\n".join(lines.get(i, "") for i in range(5)))], "doc_id long, text string")
    titles = run(spark, tmp_path, "P07_built_documents", documents=docs)[0]["title_tags"].split("|")
    assert titles[1:] == ["Enai Leletre Anque Enmenttion Eaution", "Oution Ouchan Ment Enan Mentou"]


def test_phrases_beyond_the_first_count_where_these_are_too_few(spark, monkeypatch):
    monkeypatch.setattr(enrich, "AHEAD", 1)
    rnd = random.Random(5)
    rows = [[rnd.choice(["ab", "abc", "Abc,", "x", "yy", "(zz)", "", "q" + str(i % 9)]) for i in range(n)] for n in (0, 1, 3, 4, 40, 200)]
    given = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, p array<string>")
    got = {r["id"]: (r["a"], r["d"]) for r in given.select("id", enrich.apart(F.col("p"), 3).alias("a"), enrich.different(F.col("p"), 3).alias("d")).collect()}
    assert got == {i: (apart(r, 3), first(forms(r), 3)) for i, r in enumerate(rows)}


def test_keyphrases_are_counted_where_they_lie(spark, tmp_path):
    rows = [(1, "reth barok reth barok"), (2, "selim tavon"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "hashpartitioning" not in entry.queries()["T21_keyphrases"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([*rows, (2, "selim oren")], "doc_id long, text string").write.parquet(f"{tmp_path}/again/documents.parquet")
    got = sorted((r["doc_id"], r["keyphrases"]) for r in entry.queries()["T21_keyphrases"](spark, f"{tmp_path}/again").collect())
    assert got == [(1, "|".join(keyphrases(rows[0][1]))), (2, "selim oren|tavon"), (2, "selim oren|tavon"), (3, "")]


def test_words_asked_for_are_found_as_among_all_tokens(spark):
    rnd = random.Random(6)
    pool = "eran the of bcs303 12ab 007 00 0 x 00a11 thing and9 erand 3 a1b2".split()
    rows = [(i, " ".join(rnd.choice(pool[: 4 + i]) for _ in range(rnd.randint(0, 9)))) for i in range(40)] + [(99, "eran the thing")]
    given = spark.createDataFrame(rows, "doc_id long, t string")
    for r in given.select("t", search.tokens_of(F.col("t")).alias("every"), search._asked_words(F.col("t")).alias("some")).collect():
        assert set(r["every"]) <= set(r["some"])
        assert all(w == "" or w in search.STOP or re.fullmatch("0[0-9]+", w) for w in set(r["some"]) - set(r["every"]))


def test_fields_of_one_content_score_as_others_do(spark):
    docs = [(1, "Eran things", "Eran things", "eran"), (2, "Eran things", "Eran  things!", "eran"), (3, "erna", "erna", ""), (4, "x", "y 7", None), (5, None, None, "eran")]
    given = spark.createDataFrame(docs, "doc_id long, clean_text string, text string, file_name string")
    for query in ("eran", "eran thing", "7"):
        got = {r["doc_id"]: r["score"] for r in search.searched(given, query).collect()}
        apart_ = given.withColumn("text", F.concat("text", F.lit(" .")))  # another content of the same plain form
        assert got == {r["doc_id"]: r["score"] for r in search.searched(apart_, query).collect()} and got
    assert got == {4: 161.2}  # 2 * (2 + 1.5 + 1 + ln(6 / 2)) + 150


def test_terms_are_found_in_different_words_as_in_the_text(spark):
    rnd = random.Random(7)
    pool = "bookmark sheets sheet mark sheetmark bcs 303 bcs303 bc s3 03 b <html> .c # / _ - \t   é".split(" ")
    rows = [(i, "".join(rnd.choice(pool) + rnd.choice(["", " ", " ", "\n "]) for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.<>\s]+", " ", re.sub(r"[#/\\_-]+", " ", t.lower()))).strip()
    low = spark.createDataFrame(rows, "doc_id long, t string").select("t", tx.rule_text(F.col("t")).alias("b"), tx.search_text(F.col("t")).alias("s"))
    low = low.withColumns({"w": organise.different_words(F.col("b")), "d": F.replace("b", F.lit(" "), F.lit(""))})
    terms = ["mark sheet", "sheet", "bcs303", "bcs 303", "#Mark_sheet"]
    for r in low.select("*", *(organise.has_term(F.col("b"), t, F.col("d"), F.col("w")).alias(f"k{i}") for i, t in enumerate(terms))).collect():
        assert r["b"] == plain(r["t"]) and r["s"] == re.sub("[^a-z0-9]+", " ", r["t"].lower()).strip()
        for i, t in enumerate(terms):
            assert r[f"k{i}"] == (plain(t) in r["b"] or (i in (2, 3) and "bcs303" in r["b"].replace(" ", "")))


def test_shared_runs_are_made_where_a_hash_is_known(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: rnd.choice(["", " ", "\n"]) + "".join(rnd.choice(["Ab", "c", "É"]) + rnd.choice([" ", "  ", "\t\n"]) for _ in range(rnd.choice([0, 7, 8, 9, 40, 60])))
    docs, items = [(i, text() if i else None) for i in range(25)], [(i, text() if i else None) for i in range(25)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = entry.queries()["W08_containment"](spark, str(tmp_path))
    runs = lambda t: {tuple(w[i:i + 8]) for w in [(t or "").lower().split()] for i in range(len(w) - 7)}
    want = {(d, i): len(runs(t) & runs(u)) for d, t in docs for i, u in items if runs(t) & runs(u)}
    assert want and {(r["doc_id"], r["item_id"]): r["shared"] for r in rows.collect()} == want
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi")[1].split("Relation")[0]
    assert "xxhash64" in below and "array_join" not in below  # a gram is made after the look-up

"""Numbers of links of the n-gram Jaccard join, against brute force."""

import random

import pytest

from leafmill.llm import jaccard, queries


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    s = [grams(t) for _, t in rows]
    return sorted((d, sum(i != j and bool(s[i]) and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) for j in range(len(s)))) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def near_copies():
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(25):
        w = base[:rnd.randint(115, 150)]
        w[rnd.randrange(110)] = rnd.choice(("x", "y"))
        texts.append(" ".join(w))
    return list(enumerate([*texts, *texts[:3], texts[0], "One two", "ONE two", "", "", "alone here"]))


@pytest.mark.parametrize("tile", [4096, 5, 2])
def test_no_link_is_lost(spark, near_copies, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_links"]) for r in jaccard.linked(docs, count=True).collect())
    assert got == brute(near_copies) and sum(n for _, n in got) > 4 * len(got)


def test_query_gives_links(spark, near_copies, tmp_path):
    spark.createDataFrame(near_copies, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_ngram_jaccard_join(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((r["doc_id"], r["n_links"]) for r in got.collect()) == brute(near_copies)

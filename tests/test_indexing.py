"""A kept index against one made anew, after changes, merges and races; near words against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import fuzzy, indexing, search
from leafmill.sources import versions

WORDS = "alpha alpa beta betas gamma delta bcs303 007 tionate tiomate tonat größe x".split()


def texts(rnd, ids):
    return [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))) if i % 11 else None) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def same(spark, index, docs):
    rows = frame(spark, docs)
    assert (index.docs, index.words) == (len(docs), rows.select(F.sum(F.size(F.filter(F.split(search.search_text(F.col("text")), " "), lambda w: w != "")))).head()[0] or 0)
    want = {(r["token"], r["doc_id"], r["tf"], r["doc_len"]) for r in search.postings(rows).collect()}
    assert {tuple(r) for r in index.postings().collect()} == want
    assert sorted(r["doc_id"] for r in index.sizes().collect()) == sorted(i for i, _ in docs)
    for query in ("alpha beta", "nowhere", ""):
        got = [(r["doc_id"], round(r["score"], 9)) for r in index.bm25(query, 7).collect()]
        assert got == [(r["doc_id"], round(r["score"], 9)) for r in search.bm25(rows, query, 7).collect()]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def test_changes_and_merges_give_the_index_made_anew(spark, path):
    rnd, held = random.Random(1), {}
    index = indexing.opened(spark, path, 2)
    assert index.bm25("alpha").count() == 0
    for step in range(3):
        new = texts(rnd, rnd.sample(range(40), 15))
        gone = rnd.sample(range(60), 8 if step else 0)
        gone = [i for i in gone if i not in dict(new)]
        index = index.changed(frame(spark, new), frame(spark, [(i, None) for i in gone]))
        held = {i: t for i, t in held.items() if i not in gone} | dict(new)
        assert index.version == step + 1 and len(index.segments) == step + 1
    same(spark, index, sorted(held.items()))
    same(spark, indexing.opened(spark, path), sorted(held.items()))
    merged = index.merged()
    assert len(merged.segments) == 1
    same(spark, merged, sorted(held.items()))
    same(spark, index, sorted(held.items()))  # the version before is still there
    merged.cleaned()
    same(spark, indexing.opened(spark, path), sorted(held.items()))


def test_ids_out_of_force_travel_and_the_last_segments_are_not_joined(spark, path):
    index = indexing.opened(spark, path, 2).changed(frame(spark, [(1, "alpha beta"), (2, "beta")])).changed(frame(spark, [(2, "gamma gamma")])).changed(frame(spark, [(3, "x")]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.postings()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    same(spark, index, [(1, "alpha beta"), (2, "gamma gamma"), (3, "x")])


def test_a_search_reads_the_buckets_of_its_words_only(spark, path):
    index = indexing.opened(spark, path, 16).changed(frame(spark, texts(random.Random(2), range(50))))
    files = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in files or "PartitionFilters: [bucket" in files or "PartitionFilters: [(bucket" in files
    read = {re.search(r"bucket=(\d+)", r["f"])[1] for r in index._of("postings", indexing.POSTINGS, "token", ["alpha"]).select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1


def test_of_two_writers_one_fails(spark, path):
    first = indexing.opened(spark, path, 4).changed(frame(spark, [(1, "alpha")]))
    other = indexing.opened(spark, path)
    first = first.changed(frame(spark, [(2, "beta")]))
    with pytest.raises(versions.Taken):
        other.changed(frame(spark, [(3, "gamma")]))
    assert indexing.opened(spark, path).docs == first.docs == 2
    same(spark, other.__class__(spark, path, *versions.got(spark, path)).changed(frame(spark, [(3, "gamma")])), [(1, "alpha"), (2, "beta"), (3, "gamma")])


def test_odd_changes(spark, path):
    index = indexing.opened(spark, path, 4)
    assert index.changed(frame(spark, [])).version == 0
    index = index.changed(frame(spark, [(1, "a b"), (1, "b c"), (None, "zz"), (2, None), (3, "")]))
    same(spark, index, [(1, "b c"), (2, None), (3, "")])
    assert index.changed(None, frame(spark, [(9, None)])).version == index.version
    same(spark, index.changed(None, frame(spark, [(1, None), (2, None)])), [(3, "")])


def test_an_index_is_kept_for_the_files_it_was_made_of(spark, tmp_path):
    at = f"{tmp_path}/docs"
    frame(spark, [(1, "alpha beta")]).write.parquet(at)
    first = indexing.kept(spark.read.parquet(at), buckets=4)
    assert indexing.kept(spark.read.parquet(at), buckets=4).path == first.path
    frame(spark, [(1, "alpha"), (2, "alpha")]).write.mode("overwrite").parquet(at)
    again = indexing.kept(spark.read.parquet(at), buckets=4)
    assert again.path != first.path and again.docs == 2


# --- near words ---


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_are_those_of_all_pairs(spark, path):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc1") for _ in range(rnd.randint(1, 9))) for _ in range(900)} | {"a" * 64, "a" * 65, "b" * 66})
    index = indexing.opened(spark, path, 4).changed(frame(spark, [(i, w) for i, w in enumerate(words)]))
    for token in ("abca", "abcabc", "abcabca", "abc", "1111", "aabbccaab", "a" * 64, "a" * 63):
        for recognised in (False, True):
            most = fuzzy.allowed(token, recognised)
            want = [w for w in words if most and abs(len(w) - len(token)) <= 1 and edits(w, token) <= most]
            assert sorted(r["token"] for r in index.close(token, recognised).collect()) == want
            assert sorted(r["doc_id"] for r in index.near(token, recognised).collect()) == [words.index(w) for w in want]


@pytest.mark.parametrize("most", [20_000, 1])
def test_field_scores_are_the_same_if_near_words_stay_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(search, "NEAR", most)
    rows = [(i, f"{w}.txt", t or "", t) for (i, t), w in zip(texts(random.Random(4), range(30)), WORDS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, file_name string, clean_text string, text string")
    found = {}
    for query in ("alpha", "tionate", "bcs303", "betas 7", "größe x"):
        found[query] = sorted(map(tuple, search.searched(docs, query).collect()))
    near = {i for i, *_ in found["tionate"]}
    assert near == {i for i, name, _, t in rows if {"tionate", "tiomate"} & set(f"{t}".split()) or re.match("tionate|tiomate", name)}
    assert found == KNOWN.setdefault("found", found)


KNOWN: dict = {}

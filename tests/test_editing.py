"""Folder changes, phrases, tags and titles on small inputs."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import labels
from leafmill.operators import enrich, evaluation, folders, store

FOLDER = "folder_id string, name string, parent_id string, display_path string, sort_order int, source string, deleted_at timestamp"


@pytest.fixture()
def tree(spark):
    return spark.createDataFrame([("all-files", "All", None, "All", 0, "system", None), ("a", "A", None, "A", 1, "system", None),
                                  ("b", "B", "a", "A / B", 2, "system", None), ("u", "U", "b", "A / B / U", 3, "user", None)], FOLDER)


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def words(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_folders_are_made_and_renamed(tree):
    made = {r["folder_id"]: r for r in folders.saved(tree, " New one ", "b", stamp="x").collect()}
    assert made["user-new-one-x"]["display_path"] == "A / B / New one" and made["user-new-one-x"]["sort_order"] == 4
    renamed = {r["folder_id"]: r for r in folders.saved(tree, "V", "all-files", "u").collect()}
    assert len(renamed) == 4 and renamed["u"]["display_path"] == "V" and renamed["u"]["sort_order"] == 3


@pytest.mark.parametrize("args", [(" ",), ("x", "nowhere"), ("x", None, "a")])
def test_folders_that_cannot_be_saved(tree, args):
    with pytest.raises(ValueError):
        folders.saved(tree, *args)


def test_deleting_a_subtree(spark, tree):
    left = {r["folder_id"]: r["deleted_at"] for r in folders.deleted(tree, "a", "2024-01-01").collect()}
    assert set(left) == {"all-files", "a", "b"} and left["a"] and left["b"] and not left["all-files"]
    rows = spark.createDataFrame([(1, "u"), (2, "all-files")], "doc_id long, folder_id string")
    assert [r["doc_id"] for r in folders.without_subtree(rows, tree, "a").collect()] == [2]
    for bad in ("all-files", "nowhere"):
        with pytest.raises(ValueError):
            folders.deleted(tree, bad, "2024-01-01")


def test_deleted_defaults_stay_deleted(spark, tree):
    gone = folders.deleted(tree, "b", "2024-01-01")
    back = folders.with_defaults(gone, tree.filter("source = 'system'"))
    assert {r["folder_id"] for r in folders.active(back).collect()} == {"all-files", "a"}


def test_keyword_overrides(spark, tree):
    given = spark.createDataFrame([("a", "C#/x", "odd", 9.0, 1), ("a", "c x", "negative", None, 2), ("z", "k", "positive", 1.0, 1), ("a", "!!", "positive", 1.0, 1)],
                                  "folder_id string, keyword string, role string, weight double, at int")
    assert [tuple(r) for r in folders.keyword_overrides(given, tree).collect()] == [("a", "c x", "negative", 1.0)]


def test_phrases(spark):
    r = one(spark, enrich.apart(words(" The  Tape. ", "tape", "(Input)", "in", "", "x")).alias("a"), enrich.apart(words()).alias("b"),
            enrich.different(words("A", "a ", "--", "b"), 5).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (["the tape", "input", "x"], [], ["a", "b"])


def test_tags(spark):
    null = F.lit(None).cast("array<string>")
    r = one(spark, enrich.tag_added(null, F.lit("#C++_1")).alias("a"), enrich.tag_added(words("x"), F.lit("!!")).alias("b"), enrich.tag_removed(words("a b", "c"), F.lit("A/B")).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (["c++ 1"], ["x"], ["c"])


@pytest.mark.parametrize("given,want", [
    (("bcs303", "question", "paper"), "BCS303 Question Paper"), (("bcs303", "assignment"), "BCS303 Assignment"), (("bcs303", "memory", "tape", "input"), "BCS303 Memory Tape"),
    (("bcs303",), "BCS303 Notes"), (("machine", "turing"), "Turing Machine Notes"), (("memory", "tape", "input", "output"), "Memory Tape Input Notes"), (("memory", "notes"), ""), ((), "")])
def test_titles(spark, given, want):
    assert one(spark, enrich.generated_title(words(*given)).alias("t"))["t"] == want


def test_keyphrases_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "finite automata finite automata")], "doc_id long, text string")
    found = {r["doc_id"]: r["keyphrases"] for r in enrich.keyphrases(docs).collect()}
    assert found[1] == found[2] == [] and found[3] == ["finite automata", "automata finite"]  # 2 * 6 + 1.95 + 4; the threes score 17


def test_labels_of_nulls(spark):
    null = F.lit(None)
    r = one(spark, labels.quality_label(null, F.lit("done")).alias("q"), labels.percent(null.cast("double")).alias("p"), labels.preview(null.cast("string"), null.cast("string")).alias("t"),
            labels.short_path(F.lit("a/b/c/d/e")).alias("s"), labels.kind(F.lit("X.TIFF")).alias("k"))
    assert tuple(r) == ("Low OCR", 0, "", "a/.../c/d/e", "image")


def test_precision_without_expected_terms(spark):
    p, r = evaluation.precision_recall(words("a"), words())
    assert tuple(one(spark, p.alias("p"), r.alias("r"))) == (None, None)


def test_done_jobs_stay_done(spark):
    kind = "job_id string, document_id string, page_number int, status string, attempts int, error string, created_at string"
    old = spark.createDataFrame([("j", "d", 1, "done", 1, None, "1"), ("k", "d", 2, "failed", 3, "e", "1")], kind)
    new = spark.createDataFrame([("m", "d", 1, "pending", 0, None, "2"), ("n", "d", 2, None, None, None, "2"), ("o", "d", 3, "done", 0, None, "2")], kind)
    got = {r["page_number"]: (r["job_id"], r["status"], r["attempts"], r["created_at"]) for r in store.upserted_jobs(old, new).collect()}
    assert got == {1: ("m", "done", 0, "1"), 2: ("n", "pending", 0, "1")}

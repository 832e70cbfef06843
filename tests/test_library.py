"""Trees of any depth, snapshots, tables, pages, transitions and refreshes, on small tables."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.functions import cleaning, lexicon, quality
from leafmill.operators import enrich, models, organise, refresh, search, store, vectors, views
from leafmill.operators import folders as fo
from leafmill.operators import rules as R
from leafmill.sources import files, schema, snapshots
from leafmill.streaming import jobs as streams

TREE = "folder_id string, name string, parent_id string, display_path string, sort_order int, source string, deleted_at timestamp"


@pytest.fixture(scope="module")
def chain(spark):
    """Twelve levels, one folder each, and a second root."""
    rows = [(f"f{i}", f"n{i}", f"f{i - 1}" if i else None, "", i, "user", None) for i in range(12)] + [("all-files", "All Files", None, "All Files", 99, "system", None)]
    return spark.createDataFrame(rows, TREE)


def test_trees_of_twelve_levels(spark, chain):
    up = {(r[0], r[1]): r[2] for r in store.ancestors(chain).collect()}
    assert up == {(f"f{i}", f"f{j}"): i - j for i in range(12) for j in range(i + 1)} | {("all-files", "all-files"): 0}
    assigned = spark.createDataFrame([(1, "f11"), (2, "f5"), (2, "f11"), (3, "f0")], "doc_id long, folder_id string")
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    got = {r["folder_id"]: r["n"] for r in store.folder_counts(assigned, chain, docs).collect()}
    assert got == {"f0": 3, **{f"f{i}": 2 for i in range(1, 12)}, "all-files": 5}
    assert {r[0]: r[1] for r in fo.display_paths(chain).collect()}["f11"] == " / ".join(f"n{i}" for i in range(12))


def test_a_deleted_subtree_goes_whole(spark, chain):
    left = {r["folder_id"] for r in fo.deleted(chain, "f2", "2024-01-01").collect()}
    assert left == {"f0", "f1", "all-files"}


def test_trees_without_an_end_fail(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "folder_id string, parent_id string")
    with pytest.raises(Exception, match="(?i)recursion"):
        store.ancestors(loop).collect()


def test_first_lines_stay(spark):
    given = ["b", "A", "a", "B", "c", "A ", "Ä", "ä", ""]
    row = spark.createDataFrame([(given,), ([],), (None,)], "x array<string>").select(cleaning.firsts(F.col("x"))).collect()
    assert row[0][0] == ["b", "A", "c", "A ", "Ä", ""] and row[1][0] == [] and not row[2][0]


def test_cleaned_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "x  y\nX y\n***", "mine", "too")], "id int, text string, lines string, row string")
    got = cleaning.cleaned(rows).head().asDict()
    assert got == {"id": 1, "text": "x  y\nX y\n***", "lines": "mine", "row": "too", "clean_lines": ["x y"]}


def test_merged_lines(spark):
    row = spark.createDataFrame([(["a  b\nC", None, "c\nA B\n d "],)], "x array<string>")
    assert row.select(cleaning.merged_lines(F.col("x"))).head()[0] == "a b\nC\nd"


def test_built_quality(spark):
    rows = spark.createDataFrame([(1, "Hello hello\n@@@ ###\nhello HELLO"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r for r in quality.built(rows).collect()}
    assert (got[1]["clean_text"], got[1]["raw_word_count"], got[1]["clean_word_count"], got[1]["quality"]) == ("Hello hello", 4, 2, 100)
    assert (got[2]["clean_text"], got[2]["quality"], got[2]["noise_ratio"], got[3]["clean_text"]) == ("", 0, 1.0, "")


def test_words_of_a_text_that_stays_as_it_is_are_counted_once(spark):
    texts = ["Same words, twice", "same\nSAME", " edge", None, "", "Größe 12\nx"]
    rows = quality.built(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    want = [3, 2, 1, 0, 0, 3]
    assert [(r["raw_word_count"], r["clean_word_count"]) for r in sorted(rows.collect(), key=lambda r: r["id"])] == list(zip(want, [3, 1, 1, 0, 0, 3], strict=True))
    assert re.search(r"CASE WHEN \(\S*text\S* = \S*clean_text\S*\) THEN", rows._jdf.queryExecution().analyzed().toString())


# --- pages ---


def test_page_texts_follow_the_policy(spark):
    rows = spark.createDataFrame([(1, "x" * 30, "seen", False), (2, "short", "seen", False), (3, "y" * 30, "seen", True), (4, None, None, False)],
                                 "page_number int, embedded string, recognised string, has_image boolean")
    got = {r["page_number"]: (r["needs_recognition"], r["text"]) for r in files.page_texts(rows).collect()}
    assert got == {1: (False, "x" * 30), 2: (True, "short\n\nseen"), 3: (True, "y" * 30 + "\n\nseen"), 4: (True, "")}


def test_one_page_and_its_range(spark):
    rows = spark.createDataFrame([("d", i, f"p{i}") for i in (1, 2, 3)], "document_id string, page_number int, text string")
    assert files.page(rows, "d", 2).head()["text"] == "p2"
    for bad in (0, 4):
        with pytest.raises(Exception, match="is not in 1 to 3"):
            files.page(rows, "d", bad).collect()


def test_scanned_files_that_fail_are_told_apart(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.docx").write_bytes(b"broken")
    done, failed = files.scanned(files.scan(spark, str(tmp_path)), lambda t: t.select("file_name", F.length("text").alias("n")))
    assert [tuple(r) for r in done.collect()] == [("a.md", 5)] and [r["file_name"] for r in failed.collect()] == ["b.docx"]


# --- the queue ---

JOB = "job_id string, document_id string, page_number int, status string, attempts int, created_at int, error string"


def test_claims_and_ends(spark):
    rows = spark.createDataFrame([("a", "d", 1, "pending", 0, 2, None), ("b", "d", 2, "pending", 2, 1, None), ("c", "d", 3, "pending", 3, 0, None), ("e", "d", 4, "done", 1, 0, None)], JOB)
    now = store.claimed(rows, 2)
    assert {(r["job_id"], r["status"], r["attempts"]) for r in now.collect()} == {("a", "processing", 1), ("b", "processing", 3), ("c", "pending", 3), ("e", "done", 1)}
    results = spark.createDataFrame([("a", False, "x", None), ("b", False, "y", None)], "job_id string, ok boolean, error string, text string")
    assert {(r["job_id"], r["status"], r["error"]) for r in store.finished(now, results).collect()} == {("a", "pending", "x"), ("b", "failed", "y"), ("c", "pending", None), ("e", "done", None)}
    good = spark.createDataFrame([("a", True, None, "text")], "job_id string, ok boolean, error string, text string")
    pages = spark.createDataFrame([("d", 1, "old", "done"), ("d", 9, "stays", "done")], "document_id string, page_number int, text string, status string")
    assert {(r["page_number"], r["text"]) for r in store.completed(pages, now, good).collect()} == {(1, "text"), (9, "stays")}


def test_queue_drains_in_batches(spark, tmp_path):
    rows = spark.createDataFrame([(f"j{i}", "d", i, "pending", 0, i, None) for i in range(5)], JOB)
    pages, left = streams.drained(rows, lambda t: t.select("job_id", F.lit(True).alias("ok"), F.concat(F.lit("t"), "page_number").alias("text"), F.lit(None).cast("string").alias("error")), str(tmp_path), 2)
    assert sorted(r["text"] for r in pages.collect()) == [f"t{i}" for i in range(5)] and left.count() == 0


def test_backfill_by_version(spark):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, clean string")
    empty = F.col("clean") == ""
    assert [df.count() for df in store.rebuilt(rows, "id", empty, 8, 8)] == [2, 1]
    assert [df.count() for df in store.rebuilt(rows, "id", empty, 8, 7)] == [3, 0]
    assert [df.count() for df in store.rebuilt(rows, "id", empty, 8, None)] == [3, 0]


# --- views ---


def test_summaries_and_paths(spark):
    docs = spark.createDataFrame([("a", "x//y", "", ["t1", "t2"], "", None), ("b", "", "x/z", [], "text", "clean")],
                                 "document_id string, file_path string, primary_path string, title_tags array<string>, text string, clean_text string")
    hits = spark.createDataFrame([("x/./y", 0.51239), ("x/z", None), ("nowhere", 0.9)], "file_path string, similarity double")
    got = {r["document_id"]: (r["preview"], r["has_full_text"], r["score"]) for r in views.found_by_meaning(hits, docs).collect()}
    assert got == {"a": ("t1 | t2", False, 51.24), "b": ("clean", True, 0.0)}


def test_assignments_fall_back(spark):
    tree = spark.createDataFrame([("all-files", "A", None, "A", 0, "system", None), ("x", "X", None, "X", 2, "system", None), ("y", "Y", None, "Y", 1, "system", None)], TREE)
    rows = spark.createDataFrame([(1, ["x", "y"], "x", 0.5), (2, ["y", "x"], "gone", 0.4), (3, ["gone"], "gone", 0.3)], "doc_id long, folder_ids array<string>, primary_folder string, confidence double")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    got = {(r["doc_id"], r["folder_id"], r["is_primary"]) for r in views.assigned(rows, tree, docs).collect()}
    assert got == {(1, "x", True), (1, "y", False), (2, "y", True), (2, "x", False), (3, "y", True), (4, "y", True)}


def test_organised_again_after_an_edit(spark, tmp_path):
    def kept(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    base = spark.createDataFrame(R.flat_folders(), "folder_id string, name string, parent_id string, display_path string, sort_order int")
    tree = base.withColumns({"source": F.lit("system"), "deleted_at": F.lit(None).cast("timestamp")})
    docs = spark.createDataFrame([(1, "a.txt", "", "Unknown", "blood zebra zebra", 90, 100), (2, "b.txt", "", "Unknown", "nothing", 90, 100)],
                                 "doc_id long, file_name string, file_path string, category string, clean_text string, quality int, word_count int")
    none = spark.createDataFrame([], "folder_id string, keyword string, role string, weight double")
    single = spark.createDataFrame([(2, "images", "add")], "doc_id long, folder_id string, action string")
    before = kept(refresh.organised(docs, tree, none, single), "before")
    marked = before.withColumn("confidence", F.lit(7.0))
    edits = spark.createDataFrame([("medical", "#Zebra", "positive", 9.0)], "folder_id string, keyword string, role string, weight double")
    after = kept(refresh.organised_again(docs, marked, tree, edits, single, "medical", "zebra", ["clean_text"]), "after")
    got = {(r["doc_id"], r["folder_id"]) for r in after.collect()}
    assert (1, "medical") in got and (2, "images") in got
    assert {r["confidence"] for r in after.filter("doc_id = 2").collect()} == {7.0}
    left, rest = refresh.without_folder(docs, after, tree, edits, single, "medical", "2024-01-01")
    assert "medical" not in {r["folder_id"] for r in rest.collect()} and left.filter("folder_id = 'medical' and deleted_at is null").count() == 0


def test_reasons_and_overrides(spark):
    docs = spark.createDataFrame([(1, "a.py", "", "Certificate", "certificate unit3 text", 90, 100)], "doc_id long, file_name string, file_path string, category string, clean_text string, quality int, word_count int")
    edits = spark.createDataFrame([("certificates", "unit 3", "positive", None), ("certificates", "text", "negative", 0.1), ("images", "text", "ignored", 1.0)], "folder_id string, keyword string, role string, weight double")
    got = organise.suggested(docs, overrides=edits).head()
    plain = organise.suggested(docs).head()
    assert got["top_score"] == plain["top_score"] + 12 - 7
    assert got["reasons"][:1] == ["certificate"] and len(got["reasons"]) == 3


# --- search ---


def test_vectors_are_used_all_or_none(spark):
    rows = [(1, "a", [1.0, 0.0], ""), (2, "b", [0.0, 1.0], ""), (3, " ", None, "")]
    kind = "doc_id long, text string, vector array<double>, made_of string"
    hits, state = vectors.semantic(spark.createDataFrame(rows, kind), [1.0, 0.0])
    assert [tuple(r) for r in hits.collect()] == [(1, 1.0), (2, 0.0)] and state.head()["mode"] == "cached"
    for bad in ((2, "b", [0.0, 1.0, 2.0], ""), (2, "b", [float("nan"), 1.0], ""), (2, "b", None, ""), (2, "b", [0.0, 1.0], "stale")):
        hits, state = vectors.semantic(spark.createDataFrame([rows[0], bad], kind), [1.0, 0.0])
        assert hits.count() == 0 and state.head()["mode"] == "mixed"
    assert vectors.semantic(spark.createDataFrame([], kind), [1.0])[1].head()["mode"] == "live"


def test_search_without_hits_falls_back(spark):
    docs = spark.createDataFrame([(1, "Zebra notes", "x"), (2, "other", "zebra crossing zebr")], "doc_id long, file_name string, text string")
    assert [r["doc_id"] for r in search.ranked(search.two_stage(docs, "zebra")).collect()] == [2]
    assert {r["doc_id"] for r in search.two_stage(docs, "notes").collect()} == {1}
    assert {r["doc_id"] for r in search.substring_search(docs, " ZEBRA ").collect()} == {1, 2}


def test_worker_output_joins(spark):
    docs = spark.createDataFrame([("f1", 1), ("f2", 2)], "file string, id int")
    out = spark.createDataFrame([("f1", ["k"], None)], "file string, keyphrases array<string>, nouns array<string>")
    assert {r["id"]: (r["keyphrases"], r["nouns"]) for r in enrich.with_output(docs, out).collect()} == {1: (["k"], []), 2: ([], [])}


# --- snapshots and tables ---


def test_snapshots_of_both_forms(spark, tmp_path):
    new = {"version": 3, "documents": [{"documentId": "d1", "fileHash": "h1", "fileName": "a", "filePath": "x\\\\a", "paths": ["x//a", "y/a"], "text": "own"}, {"fileName": "lone", "ocrText": "Read  it\nread it"}],
           "pages": [{"documentId": "d1", "pageNumber": 2, "embeddedText": "e", "ocrText": "o"}], "jobs": [{"jobId": "j1", "status": "done"}, {"jobId": "j2", "status": "pending"}], "tags": [{"documentId": "d1", "tagType": "title", "tag": "t"}]}
    old = [{"documentId": "d9", "filePath": "z", "text": "t", "textQuality": 7, "scannedAt": "2020"}]
    for i, x in enumerate((new, old, "neither")):
        (tmp_path / f"{i}.json").write_text(json.dumps(x, indent=1))
    got = snapshots.read(spark, str(tmp_path))
    assert set(got) == set(snapshots.SECTIONS) and len(got) == 11
    docs = {r["file_hash"]: r for r in got["documents"].collect()}
    lone = "legacy_" + b"lone".hex()
    assert set(docs) == {"h1", lone, "legacy_" + b"z".hex()}
    assert docs["h1"]["text"] is None and docs["h1"]["paths"] == ["x/a", "y/a"] and docs["h1"]["title_tags"] == []
    assert (docs[lone]["document_id"], docs[lone]["text"], docs[lone]["clean_text"]) == ("doc_" + lone[:24], "Read  it\nread it", "Read it")
    assert docs["legacy_" + b"z".hex()]["text_quality"] == 7 and docs["legacy_" + b"z".hex()]["updated_at"] == "2020"
    assert [(r["page_number"], r["text"]) for r in got["pages"].collect()] == [(2, "e\n\no")]
    assert [r["jobId"] for r in got["jobs"].collect()] == ["j2"] and got["tags"].count() == 1 and got["embeddings"].count() == 0
    snapshots.write({"tags": got["tags"]}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "tags")).count() == 1
    assert snapshots.loaded(spark.createDataFrame([], "document_id string"), got).count() == 3


def test_both_forms_of_snapshots_are_read_in_one_pass(spark, tmp_path):
    docs = [(n, None if n == 4 else f"Text  {n} .\ntext {n}." if n else "", "s") for n in range(45)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["S29_snapshot_documents"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # documents, and ids of pages
    got = {r["document_id"]: r for r in rows.collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for n, text, _ in docs:
        clean = "given" if n % 5 == 0 else f"Text {n}." if text else ""
        assert tuple(got[f"d{n}"])[1:] == (f"h{n}" if n % 2 == 0 else ("legacy_" + f"s//{n}".encode().hex())[:55], f"s/{n}", md5(clean), "" if n % 3 == 0 else md5(text or ""))


def test_tables_of_a_library(spark, tmp_path):
    path = str(tmp_path)
    assert schema.loaded(spark, path)["documents"].count() == 0
    assert schema.saved({"folders": spark.createDataFrame([("f", "n")], "folder_id string, name string")}, path) == 1
    got = schema.loaded(spark, path)
    assert set(got) == set(schema.TABLES) and got["folders"].head()["name"] == "n" and got["folders"].head()["sort_order"] is None
    assert got["documents"].count() == 0 and got["documents"].schema["title_tags"].dataType.simpleString() == "array<string>"
    # a version that broke off doesn't count
    spark.createDataFrame([("half",)], "folder_id string").write.parquet(f"{path}/2/folders")
    assert schema.loaded(spark, path)["folders"].head()["folder_id"] == "f"
    assert schema.saved({"folders": got["folders"].withColumn("name", F.lit("new"))}, path) == 2
    assert schema.loaded(spark, path)["folders"].head()["name"] == "new"


def test_edits_of_single_documents(spark, chain):
    old = spark.createDataFrame([(1, "f1", "add"), (2, "f2", "add")], "doc_id long, folder_id string, action string")
    new = spark.createDataFrame([(1, "f1", "remove"), (3, "gone", "add"), (3, "f3", "other"), (4, "f4", "add")], "doc_id long, folder_id string, action string")
    got = fo.single_saved(old, new, chain)
    assert {tuple(r) for r in got.select("doc_id", "folder_id", "action").collect()} == {(1, "f1", "remove"), (2, "f2", "add"), (4, "f4", "add")}
    assert {r["doc_id"] for r in fo.single_deleted(got, old).collect()} == {4}
    assert [r["folder_id"] for r in fo.of_ids(chain, ["f3", "f1", "gone"]).collect()] == ["f1", "f3"]


# --- models and corrections ---


def test_models_are_loaded_once_and_rows_may_fail(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "", None, "bad", "abc"])], "id long, text string").repartition(1)

    def make():
        return {"calls": 0}

    def apply(model, text):
        model["calls"] += 1
        if text == "bad":
            raise ValueError("no")
        return [len(text), model["calls"]]

    got = {r["id"]: (r["output"], r["error"]) for r in models.by_model(docs, "own", make, apply, "array<int>").collect()}
    assert {i: x[0][0] for i, x in got.items() if x[0]} == {0: 2, 1: 0, 2: 0, 4: 3} and got[3] == (None, "ValueError: no")
    assert sorted(x[0][1] for x in got.values() if x[0]) == [1, 2, 3, 5]
    assert models.capabilities({"numbers": "numpy", "nothing": "no_such_library"}) == {"numbers": True, "nothing": False}


def test_corrections_are_the_patterns(spark):
    words = [w for p, _ in lexicon.CORRECTIONS for w in re.findall("[a-z]+", p)] + ["tapes", "xtape", "", "machine", "control"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lexicon.corrected(F.col("w")).alias("c"))
    want = lambda w: next((right for p, right in lexicon.CORRECTIONS if re.search(p, w)), w)
    assert all(r["c"] == want(r["w"]) for r in rows.collect())
    assert lexicon.spelled_out([(r"^a+$", "b")]) is None
    assert len(lexicon.merged()) == lexicon.sizes()["common"] > 200

"""Tables with change logs, and files taken into them, against plain dictionaries."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from leafmill.sources import library, schema, versions
from leafmill.streaming import ingest

TAGS = "document_id string, tag_type string, tag string"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/library"


def tags(spark, rows):
    return spark.createDataFrame(rows, TAGS)


def held(lib, name="tags"):
    return sorted((tuple(r) for r in lib.table(name).collect()), key=str)


def test_changes_read_as_if_written_anew(spark, path):
    rnd, want = random.Random(1), {}
    lib = library.opened(spark, path)
    assert set(lib.tables()) == set(schema.TABLES) and held(lib) == []
    for step in range(5):
        new = {(rnd.choice("abcd"), "title", rnd.choice(["x", "y", None])): step for _ in range(4)}
        gone = [] if step == 0 else rnd.sample(sorted(want, key=str), min(2, len(want)))
        lib = lib.changed({"tags": (tags(spark, list(new)), tags(spark, gone) if gone else None)})
        for k in gone:
            want.pop(k, None)
        want |= new
        assert held(lib) == sorted(want, key=str) and lib.version == step + 1 + (step > 2)
        if step == 2:
            lib = lib.compacted()
            assert held(lib) == sorted(want, key=str) and not lib.state["tables"]["tags"]["log"]
    before = library.Library(spark, path, *versions.got(spark, path, 1))
    assert len(before.state["tables"]) == 1 and before.table("tags").count() > 0
    lib = lib.compacted()
    lib.cleaned()
    assert held(library.opened(spark, path)) == sorted(want, key=str)


def test_rows_are_replaced_whole_and_several_tables_at_once(spark, path):
    docs = spark.createDataFrame([("d1", "one", {"k": "v"}), ("d2", "two", None)], "document_id string, text string, metadata map<string,string>")
    lib = library.opened(spark, path).changed({"documents": (docs, None), "tags": (tags(spark, [("d1", "t", "x")]), None)})
    assert lib.version == 1
    lib = lib.changed({"documents": (spark.createDataFrame([("d1", "new")], "document_id string, text string"), None), "tags": (None, tags(spark, [("d1", "t", "x"), ("none", "t", "x")]))})
    assert {r["document_id"]: (r["text"], r["metadata"]) for r in lib.table("documents").collect()} == {"d1": ("new", None), "d2": ("two", None)}
    assert held(lib) == [] and lib.version == 2
    assert lib.changed({"tags": (tags(spark, []), None)}).version == 2


def test_of_two_writers_the_second_fails_and_readers_see_one_version(spark, path):
    first = library.opened(spark, path).changed({"tags": (tags(spark, [("a", "t", "1")]), None)})
    other = library.opened(spark, path)
    first.changed({"tags": (tags(spark, [("b", "t", "2")]), tags(spark, [("a", "t", "1")]))})
    with pytest.raises(versions.Taken):
        other.changed({"tags": (tags(spark, [("c", "t", "3")]), None)})
    assert held(other) == [("a", "t", "1")] and held(library.opened(spark, path)) == [("b", "t", "2")]
    folders = {"folders": spark.createDataFrame([("f", "n")], "folder_id string, name string")}
    at = path + "-whole"
    assert schema.saved(folders, at) == 1 and schema.saved(folders, at, after=1) == 2
    with pytest.raises(versions.Taken):
        schema.saved(folders, at, after=1)
    assert schema.loaded(spark, at)["folders"].count() == 1


def test_a_writer_that_died_holds_its_number_for_a_while_only(spark, path, tmp_path, monkeypatch):
    lib = library.opened(spark, path).changed({"tags": (tags(spark, [("a", "t", "1")]), None)})
    (tmp_path / "library/versions/2.taken").touch()
    with pytest.raises(versions.Taken):
        lib.changed({"tags": (tags(spark, [("b", "t", "1")]), None)})
    monkeypatch.setattr(versions, "STALE", -5)
    assert lib.changed({"tags": (tags(spark, [("b", "t", "1")]), None)}).version == 2


# --- files ---


def files(spark, rows):
    made = [(p, hashlib.sha256(t.encode()).hexdigest(), t, n) for p, t, n in rows]
    return spark.createDataFrame(made, "file_path string, file_hash string, text string, n int").select("file_path", "file_hash", "text", F.timestamp_seconds("n").alias("at"))


def state(lib):
    docs = {r["document_id"]: r["text"] for r in lib.table("documents").collect()}
    where = {}
    for r in lib.table("document_paths").collect():
        assert r["file_path"] not in where, "a path has one document"
        where[r["file_path"]] = r["document_id"]
    return docs, {p: docs[d] for p, d in where.items()}


def test_equal_files_are_one_document_with_both_paths(spark, path):
    lib = ingest.taken_in(path, files(spark, [("/a/1.txt", "same text", 1), ("/b/2.txt", "same text", 2), ("/c.txt", "other", 3)]))
    docs, where = state(lib)
    assert sorted(docs.values()) == ["other", "same text"] and where == {"/a/1.txt": "same text", "/b/2.txt": "same text", "/c.txt": "other"}
    first = {t: d for d, t in docs.items()}
    one = lib.table("documents").filter("text = 'same text'").head()
    assert (one["primary_path"], one["file_name"], one["raw_word_count"]) == ("/a/1.txt", "1.txt", 2)
    # a third path later, a content that replaces one, and a path that moves to what is stored
    lib = ingest.taken_in(path, files(spark, [("/d.txt", "same text", 4), ("/c.txt", "newer", 5)]))
    docs, where = state(lib)
    assert docs == {first["same text"]: "same text", first["other"]: "newer"} and where["/d.txt"] == "same text" and lib.version == 2
    lib = ingest.taken_in(path, files(spark, [("/c.txt", "same text", 6), ("/e.txt", "", 7)]))
    docs, where = state(lib)
    assert where == {"/a/1.txt": "same text", "/b/2.txt": "same text", "/c.txt": "same text", "/d.txt": "same text", "/e.txt": ""}
    again = ingest.taken_in(path, files(spark, [("/c.txt", "same text", 8), ("/a/1.txt", "same text", 8)]))
    assert again.version == lib.version and state(again) == (docs, where)


def test_one_path_of_two_and_contents_that_swap(spark, path):
    ingest.taken_in(path, files(spark, [("/a", "one", 1), ("/b", "one", 1), ("/c", "two", 1)]))
    docs, where = state(ingest.taken_in(path, files(spark, [("/a", "three", 2), ("/b", "four", 2), ("/c", "one", 2)])))
    assert where == {"/a": "three", "/b": "four", "/c": "one"}


def test_a_stream_of_files_and_its_batches_again(spark, path, tmp_path):
    given = tmp_path / "given"
    files(spark, [("/a", "one", 1), ("/b", "one", 2)]).write.parquet(f"file://{given}")
    rows = spark.read.parquet(f"file://{given}")

    def run(checkpoint):
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{given}")
        ingest.ingesting(stream, path, f"file://{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return library.opened(spark, path)

    first = run("one")
    assert state(first)[1] == {"/a": "one", "/b": "one"} and first.version == 1
    assert run("one").version == 1
    assert run("two").version == 1  # the same batch from a stream that begins anew
    files(spark, [("/c", "two", 3)]).write.mode("append").parquet(f"file://{given}")
    assert state(run("one"))[1] == {"/a": "one", "/b": "one", "/c": "two"}


def test_files_are_told_apart_without_their_texts(spark, tmp_path):
    path, at = f"file://{tmp_path}/lib", f"file://{tmp_path}/resolved"
    made = ingest.changes(library.opened(spark, path), files(spark, [(f"/{i}.txt", f"text {i % 3}", i) for i in range(6)]), at)
    own = spark.read.parquet(f"{at}/own")
    assert "text" not in own.columns and own.count() == 3 and own.select("document_id").distinct().count() == 3
    assert sorted((r["text"], r["scanned_at"][-2:]) for r in made["documents"][0].collect()) == [("text 0", "00"), ("text 1", "01"), ("text 2", "02")]

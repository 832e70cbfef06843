"""After changes, the refreshed state is the one worked out anew, and only changed documents are looked at."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import incremental, refresh
from leafmill.sources import library

WORDS = {"stop": ["for"], "domain": ["network"], "common": ["report", "meeting"]}


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, text string").withColumns({"file_name": F.lit("a.txt"), "file_hash": F.col("document_id"), "primary_path": F.concat(F.lit("/"), "document_id")})


def pages(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, text string, status string")


def jobs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, job_id string, status string")


def state(rows):
    names = ["document_id", "title_tags", "keyword_tags", "clean_text", "text_quality", "raw_word_count", "clean_word_count", "noise_ratio", "indexed_pages", "status"]
    return sorted(map(str, rows.select(*(F.col(n).cast("string").alias(n) for n in names)).collect()))


def anew(lib):
    return state(refresh.synced(*(lib.table(n) for n in incremental.SOURCES), **WORDS))


@pytest.fixture
def lib(spark, tmp_path):
    own = library.opened(spark, f"file://{tmp_path}/library")
    own = own.changed({"documents": (docs(spark, [(f"d{i:02}", f"Report {i} for the network  meeting\nReport {i}") for i in range(20)]), None),
                       "pages": (pages(spark, [(f"d{i:02}", n, f"page {n} of meeting {i}", "done") for i in range(0, 20, 3) for n in (1, 2)]), None)})
    return incremental.refreshed(own.compacted(), **WORDS)


def test_refreshed_is_worked_out_anew(spark, lib, monkeypatch):
    assert state(lib.table("documents")) == anew(lib)
    assert incremental.touched(lib).count() == 0 and incremental.refreshed(lib).version == lib.version
    lib = lib.compacted()
    assert incremental.touched(lib).count() == 0
    lib = lib.changed({"documents": (docs(spark, [("d02", "Changed before the log was merged")]), None)}).compacted()
    assert incremental.touched(lib) is None  # it can't be told any more
    lib = incremental.refreshed(lib, **WORDS)
    lib = lib.changed({"documents": (docs(spark, [("d01", "Another network for the report"), ("new", "A new report")]), docs(spark, [("d19", None)])),
                       "pages": (pages(spark, [("d03", 2, "second page again", "done"), ("d04", 1, "first page", "failed")]), pages(spark, [("d06", 1, None, None)]))})
    lib = lib.changed({"jobs": (jobs(spark, [("d07", 1, "j", "pending")]), None)})
    want = {"d01", "d03", "d04", "d06", "d07", "d19", "new"}
    assert {r["document_id"] for r in incremental.touched(lib).collect()} == want
    seen, synced = [], refresh.synced
    monkeypatch.setattr(refresh, "synced", lambda d, *rest, **words: seen.append([r["document_id"] for r in d.collect()]) or synced(d, *rest, **words))
    after = incremental.refreshed(lib, **WORDS)
    assert sorted(seen[0]) == sorted(want - {"d19"})
    monkeypatch.undo()
    assert state(after.table("documents")) == anew(after) and after.version == lib.version + 1
    by_id = {r["document_id"]: r for r in after.table("documents").collect()}
    assert by_id["d07"]["status"] == "indexing" and by_id["new"]["file_name"] == "a.txt" and "d19" not in by_id


def test_few_ids_reach_the_files_and_many_are_joined(spark, lib, monkeypatch):
    lib = lib.compacted()
    ids = spark.createDataFrame([("d05",), ("d06",)], "document_id string")
    plan = incremental.of_documents(lib, "documents", ids)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(document_id" in plan
    few = sorted(r["document_id"] for r in incremental.of_documents(lib, "pages", ids).collect())
    monkeypatch.setattr(incremental, "FEW", 1)
    assert sorted(r["document_id"] for r in incremental.of_documents(lib, "pages", ids).collect()) == few == ["d06", "d06"]

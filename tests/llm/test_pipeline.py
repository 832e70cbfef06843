"""The pipeline's stages on the smallest tables: columns, and what each one must do."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as p
from leafmill.llm import common, jaccard, suffix

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_stages(spark):
    docs = first = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, DIR), "stage")
        assert docs.columns == first.columns, name
        assert docs.filter("n_chars <> length(text)").count() == 0
        seen.append(docs.count())
        if name.startswith("n-gram"):
            assert jaccard.linked(docs).filter("doc_id <> component_id").count() == 0
        if name.startswith("suffix"):
            assert docs.filter("text = ''").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > seen[0] / 2
    out = p.STAGES[-1][1](spark, docs, DIR)
    assert out.select("doc_id").distinct().count() == seen[-1]


def test_suffix_stage_removes_what_repeats(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before, after = suffix.report(docs).agg(F.sum("n_removed")).head()[0], None
    cut = common.stored(p.cut_repeats(spark, docs, DIR), "cut")
    after = cut.agg(F.sum(F.octet_length("text"))).head()[0]
    assert docs.agg(F.sum(F.octet_length("text"))).head()[0] - after >= before > 0


def test_all_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names

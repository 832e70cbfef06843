"""Enrichment that breaks off and goes on, and the measures of its stages."""

import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators import enriching

KIND = "array<string>"


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/outputs"


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, text string")


def calls(folder):
    return sorted(line for f in os.listdir(folder) for line in open(f"{folder}/{f}").read().split("\n")[:-1]) if os.path.isdir(folder) else []


def model(folder, stop):
    """A model that writes down what it is asked, and can't be used while `stop` names a text."""
    os.makedirs(folder, exist_ok=True)

    def apply(m, text):
        if os.path.exists(stop) and text in open(stop).read().split():
            os._exit(1)  # the worker dies
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(text + "\n")
        if text.startswith("bad"):
            raise ValueError(text)
        return [text.upper()]

    return apply


def test_a_run_that_breaks_off_goes_on(spark, path, tmp_path):
    folder, stop = str(tmp_path / "calls"), str(tmp_path / "stop")
    apply = model(folder, stop)
    rows = docs(spark, [(f"d{i}", f"t{i}") for i in range(12)] + [("d0", "t0"), (None, "none")])
    run = lambda: enriching.enriched(rows, path, "own", dict, apply, KIND, batch=4)
    last = [r["id"] for r in enriching.due(rows, path, KIND).filter(F.pmod(F.xxhash64("id"), F.lit(3)) == 2).collect()]
    (tmp_path / "stop").write_text(" ".join(f"t{i[1:]}" for i in last))
    with pytest.raises(Exception, match="(?i)worker|crash|abort"):
        run()
    kept = {r["id"] for r in enriching.outputs(spark, path, KIND).collect()}
    assert kept == {f"d{i}" for i in range(12)} - set(last) and last
    (tmp_path / "stop").unlink()
    before = calls(folder)
    got = {r["id"]: r["output"] for r in run().collect()}
    assert got == {f"d{i}": [f"T{i}"] for i in range(12)}
    assert sorted(set(calls(folder)) - set(before)) == sorted(f"t{i[1:]}" for i in last) and len(calls(folder)) - len(before) == len(last)
    run()
    assert len(calls(folder)) - len(before) == len(last)


def test_failures_are_tried_again_apart_and_changed_texts_anew(spark, path, tmp_path):
    folder = str(tmp_path / "calls")
    apply = model(folder, str(tmp_path / "stop"))
    rows = docs(spark, [("a", "good"), ("b", "bad one"), ("c", None)])
    for n in range(1, 5):
        got = {r["id"]: (r["output"], r["error"], r["tries"]) for r in enriching.enriched(rows, path, "own", dict, apply, KIND).collect()}
        assert got == {"a": (["GOOD"], None, 1), "b": (None, "ValueError: bad one", min(n, 3)), "c": ([""], None, 1)}
    assert calls(folder) == ["", "bad one", "bad one", "bad one", "good"]
    again = {(r["id"], r["output"][0]) for r in enriching.enriched(docs(spark, [("a", "new"), ("b", "better")]), path, "own", dict, apply, KIND).filter("error IS NULL").collect()}
    assert {("a", "NEW"), ("b", "BETTER"), ("a", "GOOD")} <= again
    assert enriching.enriched(docs(spark, []), path + "-none", "own", dict, apply, KIND).count() == 0


def test_a_model_that_cannot_be_made_ends_the_run(spark, path):
    def make():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        enriching.enriched(docs(spark, [("a", "x")]), path, "never", make, lambda m, t: [t], KIND)
    assert enriching.outputs(spark, path, KIND).count() == 0


def test_measures_are_those_of_the_rows(spark, path, tmp_path):
    apply = model(str(tmp_path / "calls"), str(tmp_path / "stop"))
    seen = enriching.Measures({"numbers": "numpy", "nothing": "no_such_library"})
    rows = docs(spark, [(f"d{i}", f"bad {i}" if i % 4 == 0 else f"t{i}") for i in range(20)])
    enriching.enriched(rows, path, "own", dict, apply, KIND, batch=9, measures=seen)
    got = {r["stage"]: r for r in seen.report(spark).collect()}
    stages = [r for s, r in got.items() if s.startswith("own-") and "again" not in s]
    out = enriching.outputs(spark, path, KIND)
    assert sum(r["rows"] for r in stages) == out.count() == 20 and sum(r["errors"] for r in stages) == out.filter("error IS NOT NULL").count() == 5
    total = enriching._kept(spark, path, KIND).agg(F.sum("seconds")).head()[0]
    assert abs(sum(r["seconds"] for r in stages) - total) < 1e-9 and total > 0
    assert got["has numbers"]["rows"] == 1 and got["has nothing"]["rows"] == 0
    plain = seen.of("plain", spark.range(7))
    plain.collect()
    assert {r["stage"]: r["rows"] for r in seen.report(spark).collect()}["plain"] == 7

"""Elements of JSON files cut into many blocks, against the json module."""

import json
import random

import pytest

from leafmill.sources import large_json, snapshots


def odd(rnd):
    some = ['a "quoted" {brace} [x]', "back\\slash}", "\\\\", "né\n}{", "", '":[{', "x" * rnd.randint(0, 300), "], \"pages\": [{"]
    return {"documentId": f"d{rnd.randrange(10**6)}", "text": rnd.choice(some) + rnd.choice(some), "nested": {"a": [{"b": rnd.choice(some)}, []], "c": {}}, "n": rnd.random(), "none": None}


def wanted(data):
    if isinstance(data, list):
        data = {"documents": data}
    return sorted((k, json.dumps(e, sort_keys=True)) for k, v in data.items() if isinstance(v, list) for e in v if isinstance(e, dict))


@pytest.mark.parametrize("size", ["500", "3000", "1m"])
@pytest.mark.parametrize("indent", [None, 1])
def test_elements_are_those_of_the_json_module(spark, tmp_path, size, indent):
    rnd = random.Random(int(size.rstrip("m")))
    given = {
        "object": {"version": 3, "meta": {"a": {"documents": [{"no": 1}]}, "b": "}"}, "documents": [odd(rnd) for _ in range(40)], "empty": [], "pages": [1, "x{", [{"no": 1}], *(odd(rnd) for _ in range(30)), None],
                   "last": {"z": [{"no": 2}]}, "tags": [odd(rnd)], "end": {}},
        "array": [odd(rnd) for _ in range(25)], "nothing": [], "hollow": {}, "large": {"documents": [{"text": "{" * 5000}, {"text": "}" * 5000}]}}
    for name, data in given.items():
        (tmp_path / f"{name}.json").write_text("﻿" * (name == "array") + json.dumps(data, indent=indent) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = large_json.elements(spark, str(tmp_path)).collect()
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)
    for name, data in given.items():
        own = sorted((r["section"], json.dumps(json.loads(r["value"]), sort_keys=True)) for r in got if r["file"].endswith(f"/{name}.json"))
        assert own == wanted(data), name


def test_a_large_snapshot_is_read_by_several_tasks(spark, tmp_path):
    docs = [{"documentId": f"d{i}", "fileHash": f"h{i}", "fileName": "a.txt", "text": f"text {{{i}}} \" of \\ it " * 20} for i in range(200)]
    pages = [{"documentId": f"d{i}", "pageNumber": 1, "text": f"page {i}"} for i in range(0, 200, 2)]
    (tmp_path / "snapshot.json").write_text(json.dumps({"documents": docs, "pages": pages, "jobs": [{"jobId": "j", "status": "done"}, {"jobId": "k"}], "metadata": [{"key": "k", "value": "v"}]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = snapshots.read(spark, str(tmp_path))
        whole = snapshots.parsed(spark.read.text(str(tmp_path), wholetext=True))
        for name in snapshots.SECTIONS:
            drop = [c for c in ("updated_at",) if c in got[name].columns]
            a, b = (sorted(map(str, x[name].drop(*drop).collect())) for x in (got, whole))
            assert a == b, name
        assert got["documents"].count() == 200 and got["jobs"].count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

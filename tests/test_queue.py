"""The queue as a stream against the same rules in plain Python, with stuck jobs and restarts."""

import json
import random
from datetime import datetime, timedelta

import pytest

from leafmill.streaming import queue

START = datetime(2024, 1, 1)
ORDER = ["added", "claimed", "done", "failed"]


def by_rules(events, now, lease=600, attempts=3):
    """Jobs left after events, and after leases that have ended by now."""
    jobs = {}

    def give_up(j, why):
        j.update(status="failed" if j["attempts"] >= attempts else "pending", error=why, until=None)

    for e in sorted(events, key=lambda e: (e["at"], ORDER.index(e["kind"]))):
        j = jobs.get(e["job_id"])
        if j and j["status"] == "done":
            continue
        if j and j["until"] and j["until"] <= e["at"]:
            give_up(j, "lease ended")
        if e["kind"] == "added" and not j:
            jobs[e["job_id"]] = {"status": "pending", "attempts": 0, "error": None, "until": None}
        elif e["kind"] == "claimed" and j and j["status"] == "pending":
            j.update(status="processing", attempts=j["attempts"] + 1, until=e["at"] + timedelta(seconds=lease))
        elif e["kind"] == "done" and j and j["status"] == "processing":
            j.update(status="done")
        elif e["kind"] == "failed" and j and j["status"] == "processing":
            give_up(j, e.get("error"))
    for j in jobs.values():
        if j["status"] == "processing" and j["until"] <= now:
            give_up(j, "lease ended")
    return {i: (j["status"], j["attempts"], j["error"]) for i, j in jobs.items() if j["status"] != "done"}


def at(minutes):
    return START + timedelta(minutes=minutes)


def put(folder, n, events):
    rows = [json.dumps(e | {"at": e["at"].isoformat()}) for e in events]
    (folder / f"{n:03}.json").write_text("\n".join(rows) + "\n")


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "events"
    folder.mkdir()

    def go():
        """A query of its own each time: the next one starts from the checkpoint."""
        given = spark.readStream.schema(queue.EVENTS).option("maxFilesPerTrigger", 2).json(f"file://{folder}")
        q = queue.changes(given).writeStream.outputMode("update").option(
            "checkpointLocation", f"file://{tmp_path}/checkpoint").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"file://{tmp_path}/changes")).trigger(availableNow=True).start()
        q.awaitTermination()
        left = queue.state(spark.read.schema(queue.CHANGES).parquet(f"file://{tmp_path}/changes"))
        return {r["job_id"]: (r["status"], r["attempts"], r["error"]) for r in left.collect()}

    yield folder, go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_streams_end_in_the_state_of_the_rules_also_after_restarts(run):
    folder, go = run
    rnd, every = random.Random(1), []
    for n in range(6):
        batch = []
        for i in rnd.sample(range(12), 7):
            kinds = ["added", "claimed", rnd.choice(["done", "failed", "failed", "claimed"])]
            batch += [{"job_id": f"j{i}", "kind": k, "at": at(20 * n + rnd.randint(0, 8)), "document_id": f"d{i}", "page_number": i, "error": "boom" if k == "failed" else None} for k in kinds if rnd.random() < 0.8]
        put(folder, n, batch)
        every += batch
        if n % 2:
            got = go()
            # leases end with the watermark, which this event moves on
            mark = {"job_id": f"m{n}", "kind": "added", "at": at(20 * n + 19.5)}
            put(folder, 100 + n, [mark])
            every.append(mark)
            got = go()
    put(folder, 900, [{"job_id": "end", "kind": "added", "at": at(1000)}])
    every.append({"job_id": "end", "kind": "added", "at": at(1000)})
    go()
    got = go()
    assert got == by_rules(every, at(999))


def test_a_stuck_job_is_pending_again_and_fails_at_last(run):
    folder, go = run
    put(folder, 0, [{"job_id": "a", "kind": "added", "at": at(0), "document_id": "d", "page_number": 1}, {"job_id": "b", "kind": "added", "at": at(0)}])
    for n in range(3):
        put(folder, n + 1, [{"job_id": "a", "kind": "claimed", "at": at(30 * n + 1)}])
        assert go()["a"] == ("processing", n + 1, "lease ended" if n else None)
        put(folder, 50 + n, [{"job_id": "b", "kind": "added", "at": at(30 * n + 20)}])
        assert go()["a"] == ("failed" if n == 2 else "pending", n + 1, "lease ended")
    put(folder, 90, [{"job_id": "a", "kind": "claimed", "at": at(100)}, {"job_id": "a", "kind": "done", "at": at(101)}, {"job_id": "none", "kind": "done", "at": at(101)}])
    assert go() == {"a": ("failed", 3, "lease ended"), "b": ("pending", 0, None)}

"""The page-job queue as a stream with state: one state for each job, moved by events.

Events (job_id, kind, at, and for a new job document_id, page_number) are: added, claimed, done and failed. A job that is
claimed has one more attempt and is processing until its result comes, or until its lease ends: then it is pending
again, as if it had failed, so a worker that dies holds no job for ever. After `attempts` attempts it is failed. A job
that is done goes. Restarts go on from the checkpoint.

What isn't possible is ignored: a claim of a job that isn't pending, a result of one that isn't processing (its lease has
ended, and it may be another worker's now), and anything about a job that is unknown or done. A job that is added again
before it is done stays as it is. Events of one job in one batch are taken by time, and at one time in the order above.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "job_id string, kind string, at timestamp, document_id string, page_number int, error string"
STATE = "document_id string, page_number int, status string, attempts int, error string, created_at timestamp, until long"
CHANGES = "job_id string, document_id string, page_number int, status string, attempts int, error string, created_at timestamp, at timestamp"
ORDER = {"added": 0, "claimed": 1, "done": 2, "failed": 3}


def _millis(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


class Jobs(StatefulProcessor):
    """Emits a job's row after every batch that changed it; the status of one that went is done."""

    def __init__(self, lease: int, attempts: int):
        self.lease, self.attempts = lease, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _row(self, key: str, job: dict, at) -> pd.DataFrame:
        return pd.DataFrame([(key, job["document_id"], job["page_number"], job["status"], job["attempts"], job["error"], job["created_at"], at)],
                            columns=["job_id", "document_id", "page_number", "status", "attempts", "error", "created_at", "at"])

    def _kept(self, job: dict) -> None:
        self.state.update(tuple(job[k] for k in ("document_id", "page_number", "status", "attempts", "error", "created_at", "until")))

    def _held(self) -> dict | None:
        if not self.state.exists():
            return None
        return dict(zip(("document_id", "page_number", "status", "attempts", "error", "created_at", "until"), self.state.get()))

    def _given_up(self, job: dict, why: str | None) -> None:
        job.update(status="failed" if job["attempts"] >= self.attempts else "pending", error=why, until=0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, job, changed, last = key[0], self._held(), False, None
        events = pd.concat(list(rows))
        events = events.assign(_o=events["kind"].map(ORDER)).dropna(subset=["_o", "at"]).sort_values(["at", "_o"], kind="stable")
        timer = job["until"] if job else 0
        for e in events.itertuples(index=False):
            before = dict(job) if job else None
            if job and job["until"] and job["until"] <= _millis(e.at):  # the lease had ended by then
                self._given_up(job, "lease ended")
            if e.kind == "added" and job is None:
                number = None if pd.isna(e.page_number) else int(e.page_number)
                job = {"document_id": e.document_id, "page_number": number, "status": "pending", "attempts": 0, "error": None, "created_at": e.at, "until": 0}
            elif e.kind == "claimed" and job and job["status"] == "pending":
                job.update(status="processing", attempts=job["attempts"] + 1, until=_millis(e.at) + self.lease)
            elif e.kind == "done" and job and job["status"] == "processing":
                job.update(status="done", error=None, until=0)
            elif e.kind == "failed" and job and job["status"] == "processing":
                self._given_up(job, e.error)
            if job != before:
                changed, last = True, e.at
            if job and job["status"] == "done":
                break
        until = job["until"] if job and job["status"] != "done" else 0
        if timer and timer != until:
            self.handle.deleteTimer(timer)
        if until and until != timer:
            self.handle.registerTimer(until)
        if not changed:
            return
        if job["status"] == "done":
            self.state.clear()
        else:
            self._kept(job)
        yield self._row(name, job, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._held()
        if job and job["status"] == "processing" and job["until"] <= expiredTimerInfo.getExpiryTimeInMs():
            at = datetime.fromtimestamp(job["until"] / 1000, timezone.utc).replace(tzinfo=None)
            self._given_up(job, "lease ended")
            self._kept(job)
            yield self._row(key[0], job, at)

    def close(self) -> None:
        pass


def changes(events: DataFrame, lease: str = "10 minutes", late: str = "1 minute", attempts: int = 3) -> DataFrame:
    """The stream of job rows as they change: job_id, document_id, page_number, status, attempts, error, created_at, at. A
    lease ends when the stream's watermark, `late` behind the latest event, has passed it. Needs the RocksDB state store."""
    millis = int(pd.Timedelta(lease).total_seconds() * 1000)
    return events.filter("job_id IS NOT NULL").withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(
        Jobs(millis, attempts), CHANGES, "Update", "EventTime")


def state(changed: DataFrame) -> DataFrame:
    """The queue by its changes: the last row of each job that isn't done."""
    last = changed.groupBy("job_id").agg(F.max_by(F.struct(*(c for c in changed.columns if c != "job_id")), F.struct("at", "attempts", F.col("status") != "processing")).alias("r"))
    return last.select("job_id", "r.*").filter("status <> 'done'")

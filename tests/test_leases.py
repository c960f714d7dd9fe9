"""Leases and delivery as streams: expiry, retries and finishes between batches; late and repeated frames."""

import json
from datetime import datetime, timedelta

import pytest

from marlstone.config import IngestSettings
from marlstone.operators import versions
from marlstone.streaming import leases
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set(*leases.STATE_STORE)
    yield
    spark.conf.unset(leases.STATE_STORE[0])


def at(minutes):
    return (START + timedelta(minutes=minutes)).isoformat()


def run(spark, tmp_path, schema, batches, plan):
    """Each list of events is a file and so a micro-batch; a new query continues from the checkpoint."""
    folder, sink = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    seen = []
    for i, events in enumerate(batches):
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(e) for e in events))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        query = plan(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(sink))
        query.awaitTermination()
        rows = [r.asDict() for r in spark.read.parquet(str(sink)).collect()]
        seen.append([r for r in rows if r not in [x for part in seen for x in part]])
    return seen


def event(key, kind, minutes, task, **more):
    return {"source_hash": key, "kind": kind, "at": at(minutes), "task_id": task, **more}


def test_leases_run_out_are_retried_and_finished(spark, store, tmp_path):
    batches = [
        [event("h1", "upload", 0, "t1"), event("h1", "upload", 1, "t2"), event("h2", "upload", 0, "t3")],
        # The first lease has ended when the second upload of h1 comes; h2 fails and is uploaded again.
        [event("h1", "upload", 200, "t4"), event("h2", "result", 10, "t3", ok=False, error="x" * 3000), event("h2", "retry", 12, "t3"), event("h2", "retry", 13, "t9")],
        [event("h1", "result", 201, "t1", ok=True, doc_id="late"), event("h1", "result", 202, "t4", ok=True, doc_id="d1"), event("h2", "result", 202, "t3", ok=True, doc_id="d2")],
        [event("h1", "upload", 500, "t5"), event("h1", "retry", 501, "t4"), event("h3", "upload", 500, "t6")],
        [event("h4", "upload", 900, "t7")],
    ]
    settings = IngestSettings(import_claim_lease_seconds=3600)
    seen = run(spark, tmp_path, leases.LEASE_EVENT, batches, lambda s: leases.lease_decisions(s, settings, "12 hours"))
    told = [{(r["source_hash"], r["task_id"], r["outcome"], r["attempt"]) for r in part} for part in seen]
    assert told[0] == {("h1", "t1", "acquired", 1), ("h1", "t2", "held", 1), ("h2", "t3", "acquired", 1)}
    assert told[1] == {("h1", "t4", "acquired", 2), ("h2", "t3", "failed", 1), ("h2", "t3", "reclaimed", 2), ("h2", "t9", "missing", 2)}
    assert told[2] == {("h1", "t1", "lost", 2), ("h1", "t4", "completed", 2), ("h2", "t3", "completed", 2)}
    assert told[3] == {("h1", "t5", "held", 2), ("h1", "t4", "refused:completed", 2), ("h3", "t6", "acquired", 1)}
    assert len(next(r for part in seen for r in part if r["outcome"] == "failed")["error"]) == versions.ERROR_CHARS


def test_a_lease_without_result_is_reported(spark, store, tmp_path):
    batches = [[event("h", "upload", 0, "t1")], [event("x", "upload", 100, "t2")], [event("h", "upload", 101, "t3")]]
    settings = IngestSettings(import_claim_lease_seconds=3600)
    seen = run(spark, tmp_path, leases.LEASE_EVENT, batches, lambda s: leases.lease_decisions(s, settings))
    told = {(r["source_hash"], r["task_id"], r["outcome"], r["attempt"]) for part in seen for r in part}
    assert told == {("h", "t1", "acquired", 1), ("x", "t2", "acquired", 1), ("h", "t1", "expired", 1), ("h", "t3", "acquired", 2)}


def frame(task, seq, minutes):
    return {"task_id": task, "seq": seq, "at": at(minutes), "event": "delta", "data": json.dumps({"n": seq})}


def test_frames_wait_for_gaps_and_come_once(spark, store, tmp_path):
    batches = [
        [frame("a", 2, 1), frame("a", 1, 0), frame("a", 4, 1), frame("b", 2, 1)],
        [frame("a", 3, 2), frame("a", 2, 2), frame("a", 4, 2), frame("b", 3, 2)],
        [frame("c", 1, 30)],
        [frame("c", 2, 31), frame("b", 4, 31)],
    ]
    seen = run(spark, tmp_path, leases.FRAME_EVENT, batches, lambda s: leases.deliver_in_order(s, timedelta(minutes=5), "1 minute"))
    told = [[(r["task_id"], r["seq"]) for r in part] for part in seen]
    assert sorted(told[0]) == [("a", 1), ("a", 2)] and [x for x in told[1] if x[0] == "a"] == [("a", 3), ("a", 4)]
    later = [x for part in told for x in part if x[0] == "b"]
    assert later == [("b", 2), ("b", 3), ("b", 4)] and sum(map(len, told)) == 9
    assert seen[0][0]["frame"].startswith("event: delta\ndata: {")


def test_reclaim_writes_a_new_attempt(spark):
    now = F.lit(datetime(2024, 1, 2))
    rows = [("h1", "t1", "failed", None, 1, "bad"), ("h2", "t2", "processing", datetime(2024, 1, 1), 3, ""), ("h3", "t3", "completed", None, 1, "")]
    registry = spark.createDataFrame(rows, "source_hash string, task_id string, status string, lease_until timestamp, attempt int, error string")
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "task_id string")
    got = {r.task_id: (r.outcome, r.status, r.attempt, r.error) for r in versions.reclaim(registry, tasks, now).collect()}
    assert got == {"t1": ("reclaimed", "processing", 2, ""), "t2": ("reclaimed", "processing", 4, ""), "t3": ("refused:completed", "completed", 1, "")}

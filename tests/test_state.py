"""State transitions against a plain model, and the controller's stop and rerun."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import state
from quillstream.plans.stream_queries import JOB
from quillstream.streaming import controller
from quillstream.streaming import jobs as streams
from quillstream.workspace import scratch

NOW = dt.datetime(2024, 1, 1)
COLUMNS = "job_id long, status string, phase string, attempts int, max_attempts int, lease_owner string, leased_until timestamp_ntz, last_error string, result_json string, output_path string, relay_status string, relay_result string, updated_at timestamp_ntz"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
ACTIONS = ("succeed", "skip", "fail", "defer", "manual_review", "problem_document", "retry", "reset", "cancel", "heartbeat", "progress", "nonsense")


def model(job, command, queue):
    """One command on a job, written out; returns the event."""
    a, owner, now = command["action"], command["owner"], NOW
    holds = job["status"] == "running" and owner is not None and job["lease_owner"] == owner.strip() and job["leased_until"] is not None and job["leased_until"] >= now and command["attempt"] in (None, job["attempts"])
    free = {"lease_owner": None, "leased_until": None, "updated_at": now}
    if a in state.ENDS:
        if owner is not None and not holds:
            return "stale_completion_discarded"
        relay = {None: None, '{"ok": true}': "succeeded", '{"ok": false}': "failed"}[command["relay_result"]]
        open_ = job["max_attempts"] <= 0 or job["attempts"] < job["max_attempts"]
        new = {"succeed": "succeeded", "skip": "skipped", "fail": "failed_retryable" if command["retryable"] and open_ else "failed_final", "defer": command["status"]}.get(a, a)
        job.update(free, status=new, phase=state.ENDS[a], last_error=None if a == "succeed" else command["message"])
        if a in ("succeed", "skip", "fail"):
            job["result_json"] = command["result_json"]
        if a in ("succeed", "fail"):
            job.update(relay_status=relay, relay_result=command["relay_result"])
        if a == "succeed":
            job["output_path"] = command["output_path"] or job["output_path"]
        if a == "skip":
            job["relay_status"] = "skipped"
        if a == "defer":
            job.update(attempts=max(job["attempts"] - 1, 0), relay_status="deferred", relay_result=command["relay_result"])
        return new
    if a in ("heartbeat", "progress"):
        if not holds:
            return "stale_progress_discarded" if a == "progress" else None
        job["updated_at"] = now
        if command["lease_seconds"] is not None:
            job["leased_until"] = now + dt.timedelta(seconds=command["lease_seconds"])
        if a == "progress":
            job["phase"] = command["phase"] or job["phase"]
            return "progress"
        return None
    if a in ("retry", "reset"):
        if a == "retry" and 0 < job["max_attempts"] <= job["attempts"]:
            return "retry_rejected_exhausted"
        if job["status"] not in queue.retried:
            return None
        job.update(free, status="queued", phase="queued", last_error=None, relay_status=None, relay_result=None)
        if a == "reset":
            job["attempts"] = 0
        return "retry" if a == "retry" else "retry_generation_reset"
    if a == "cancel" and job["status"] in queue.cancelled:
        job.update(free, status="cancelled", phase="cancelled")
        return "cancelled"
    return None


@pytest.mark.parametrize("queue", [state.METADATA, state.OCR, state.HTML], ids=lambda q: q.name)
def test_replay_equals_the_model(spark, queue):
    rng = random.Random(queue.name)
    statuses = ("queued", "running", "running", "running", "succeeded", "failed_retryable", "failed_final", "skipped", "cancelled", "manual_review", "problem_document", "needs_chunk_fallback")
    pick = rng.choice
    jobs = [
        dict(zip(NAMES, (i, pick(statuses), "old", rng.randrange(4), rng.randrange(-1, 4), pick(("a", "b", None)), pick((NOW, NOW + dt.timedelta(hours=1), NOW - dt.timedelta(hours=1), None)), pick((None, "e")), pick((None, "r")), pick((None, "/o")), pick((None, "x")), None, NOW - dt.timedelta(days=1))))
        for i in range(120)
    ]
    commands = [
        {
            "job_id": rng.randrange(130), "turn": t, "action": pick(ACTIONS), "owner": pick((None, " a ", "b", "c")), "attempt": pick((None, None, 0, 1, 2)), "message": f"m{t}", "retryable": pick((True, False, None)), "status": "needs_chunk_fallback",
            "phase": pick((None, "p")), "result_json": pick((None, "n")), "output_path": pick((None, "/n")), "relay_result": pick((None, '{"ok": true}', '{"ok": false}')), "lease_seconds": pick((None, 60)),
        }
        for t in range(600)
    ]
    kinds = "job_id long, turn int, action string, " + ", ".join(f"{c} {t}" for c, t in state.COMMAND.items())
    given = spark.createDataFrame([tuple(c[n.split()[0]] for n in kinds.split(", ")) for c in commands], kinds)
    table = spark.createDataFrame([tuple(j.values()) for j in jobs], COLUMNS)
    after, events = state.replay(table, given, F.lit(NOW).cast("timestamp_ntz"), "turn", queue)
    once, _ = state.transition(table, given.filter("turn = 0"), F.lit(NOW).cast("timestamp_ntz"), queue)
    got, left, one = (sorted(map(tuple, df.collect()), key=str) for df in (after, events.select("job_id", "event"), once))
    first = [dict(j) for j in jobs]
    by_id = {j["job_id"]: j for j in first}
    if commands[0]["job_id"] in by_id:
        model(by_id[commands[0]["job_id"]], commands[0], queue)
    assert one == sorted((tuple(j.values()) for j in first), key=str)
    by_id, expected = {j["job_id"]: j for j in jobs}, []
    for c in commands:
        if c["job_id"] in by_id and (event := model(by_id[c["job_id"]], c, queue)):
            expected.append((c["job_id"], event))
    assert got == sorted((tuple(j.values()) for j in jobs), key=str)
    assert left == sorted(expected, key=str)


def test_controller_stops_between_batches(spark):
    rows = spark.createDataFrame([(i, i, f"k{i}", "queued", "queued", 0, 0, NOW, NOW) for i in range(8)], "n long, job_id long, dedupe_key string, status string, phase string, attempts int, max_attempts int, created_at timestamp_ntz, updated_at timestamp_ntz")
    store = controller.Store(spark, scratch(spark, "test-controller"), JOB)
    none = lambda batch, jobs: batch.limit(0).select("job_id", F.lit("cancel").alias("action"), F.col("n").alias("turn"))
    run = controller.step(store, lambda number: F.lit(NOW).cast("timestamp_ntz"), none)

    def stop_behind_the_second(batch, number):
        run(batch, number)
        run(batch, number)  # a batch that is run again writes the same version
        if number == 1:
            store.request_stop()

    assert controller.run_until_drained(streams.replayed(spark, rows, "n", 4), store, stop_behind_the_second) == 1
    assert sorted(r["job_id"] for r in store.version(1).collect()) == [0, 1, 2, 3] and store.stop_requested()


def test_watched_files_and_problems(spark):
    at = F.lit(NOW).cast("timestamp_ntz")
    stored = spark.createDataFrame([("a", 1, 1, 2, NOW - dt.timedelta(days=1), None, NOW)], "source_path string, source_size long, source_mtime_ns long, stable_seen_count int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, updated_at timestamp_ntz")
    seen = spark.createDataFrame([("a", 1, 1), ("b", 5, 5)], "source_path string, source_size long, source_mtime_ns long")
    rows = {r["source_path"]: r for r in state.watched(stored, seen, at).collect()}
    assert rows["a"]["stable_seen_count"] == 3 and rows["b"]["stable_seen_count"] == 1 and rows["b"]["first_seen_at"] == NOW
    assert {r["source_path"]: r["unchanged"] for r in state.unchanged(seen, stored, "source_path").collect()} == {"a": True, "b": False}

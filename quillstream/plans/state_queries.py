"""State transitions over stand-ins: orders are jobs with commands, line items and events are logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.results import compact_json
from ..operators import state
from ..sources.tables import load
from .registry import query

NOW = "1996-01-01"
ACTIONS = ("succeed", "skip", "fail", "defer", "manual_review", "problem_document", "retry", "reset", "cancel", "heartbeat", "progress")
STATUSES = ("queued", "running", "succeeded", "failed_retryable", "failed_final", "skipped", "cancelled", "running", "manual_review", "problem_document", "needs_chunk_fallback")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def pick(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number + 1).cast("int"))


def state_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs with all columns of a queue; a third of the leases of running jobs are over."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    status = pick(STATUSES, k % 11)
    return load(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.col("o_orderpriority").alias("job_type"), status.alias("status"), F.lit("old").alias("phase"), (k % 4).cast("int").alias("attempts"), (k % 5 - 1).cast("int").alias("max_attempts"),
        F.when(status == "running", F.concat(F.lit("w"), text(k % 3))).alias("lease_owner"), F.when(status == "running", now() + F.make_dt_interval(hours=(k % 6 - 2).cast("int"))).alias("leased_until"),
        F.when(k % 3 == 0, "boom").alias("last_error"), F.concat(F.lit("r"), text(k)).alias("result_json"), F.when(k % 2 == 0, F.concat(F.lit("/o/"), text(k))).alias("output_path"),
        F.lit("none").alias("relay_status"), F.lit("{}").alias("relay_result"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


def state_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command for six in seven of the jobs, some by owners that do not hold the lease, some on jobs that are not there."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    rows = load(spark, sf_dir, "orders").filter(k % 7 != 0)
    return rows.select(
        F.when(k % 97 == 0, -k).otherwise(k).alias("job_id"), pick(ACTIONS, k % 13 % 11).alias("action"), F.when(k % 5 != 0, F.concat(F.lit(" w"), text(k % 3 + F.when(k % 8 == 0, 1).otherwise(0)), F.lit(" "))).alias("owner"),
        F.when(k % 2 == 0, k % 4).cast("int").alias("attempt"), F.concat(F.lit("m"), text(k)).alias("message"), (k % 3 == 0).alias("retryable"), F.lit("needs_chunk_fallback").alias("status"), F.lit("ocr").alias("phase"),
        F.concat(F.lit("n"), text(k)).alias("result_json"), F.when(k % 4 < 2, "/new").alias("output_path"), F.when(k % 3 == 1, '{"ok": true}').alias("relay_result"), F.when(k % 3 < 2, 60).alias("lease_seconds"),
    )


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


STATE_JOBS = f"""
jobs AS (
  SELECT o_orderkey AS k, {_sql_list(STATUSES)}[o_orderkey % 11 + 1] AS status, 'old' AS phase, CAST(o_orderkey % 4 AS INTEGER) AS attempts, CAST(o_orderkey % 5 - 1 AS INTEGER) AS max_attempts,
         CASE WHEN o_orderkey % 11 IN (1, 7) THEN 'w' || o_orderkey % 3 END AS lease_owner, CASE WHEN o_orderkey % 11 IN (1, 7) THEN TIMESTAMP '{NOW}' + to_hours(CAST(o_orderkey % 6 - 2 AS INTEGER)) END AS leased_until,
         CASE WHEN o_orderkey % 3 = 0 THEN 'boom' END AS last_error, o_orderdate AS created_at, o_orderpriority AS job_type FROM orders
)
"""
#: Jobs with their command (a is null without one), whether it may be done, and what retries need.
STATE_BOTH = f"""
WITH {STATE_JOBS}, both_ AS (
  SELECT *, CASE WHEN k % 7 <> 0 AND k % 97 <> 0 THEN {_sql_list(ACTIONS)}[k % 13 % 11 + 1] END AS a, CASE WHEN k % 5 <> 0 THEN 'w' || (k % 3 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) END AS own,
         CASE WHEN k % 2 = 0 THEN k % 4 END AS att, max_attempts > 0 AND attempts >= max_attempts AS spent FROM jobs
), held AS (
  SELECT *, coalesce(status = 'running' AND lease_owner = own AND leased_until >= TIMESTAMP '{NOW}' AND (att IS NULL OR att = attempts), false) AS holds FROM both_
), judged AS (
  SELECT *, coalesce(CASE WHEN a IN ('heartbeat', 'progress') THEN holds WHEN a IN ('succeed', 'skip', 'fail', 'defer', 'manual_review', 'problem_document') THEN own IS NULL OR holds
    WHEN a = 'retry' THEN status IN ('failed_retryable', 'failed_final', 'skipped', 'cancelled') AND NOT spent WHEN a = 'reset' THEN status IN ('failed_retryable', 'failed_final', 'skipped', 'cancelled')
    WHEN a = 'cancel' THEN status IN ('queued', 'failed_retryable', 'skipped') END, false) AS done FROM held
), after_ AS (
  SELECT *, CASE WHEN NOT done THEN status WHEN a = 'succeed' THEN 'succeeded' WHEN a = 'skip' THEN 'skipped' WHEN a = 'fail' THEN CASE WHEN k % 3 = 0 AND (max_attempts <= 0 OR attempts < max_attempts) THEN 'failed_retryable' ELSE 'failed_final' END
    WHEN a = 'defer' THEN 'needs_chunk_fallback' WHEN a IN ('manual_review', 'problem_document') THEN a WHEN a IN ('retry', 'reset') THEN 'queued' WHEN a = 'cancel' THEN 'cancelled' ELSE status END AS new_status FROM judged
)
"""


@query(
    "job_transitions",
    STATE_BOTH
    + f"""SELECT k AS job_id, new_status AS status, CASE WHEN NOT done THEN phase ELSE CASE a WHEN 'succeed' THEN 'complete' WHEN 'skip' THEN 'skipped' WHEN 'fail' THEN 'failed' WHEN 'defer' THEN 'deferred' WHEN 'retry' THEN 'queued'
       WHEN 'reset' THEN 'queued' WHEN 'cancel' THEN 'cancelled' WHEN 'progress' THEN 'ocr' WHEN 'heartbeat' THEN phase ELSE a END END AS phase,
       CASE WHEN done AND a = 'reset' THEN 0 WHEN done AND a = 'defer' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN NOT done OR a IN ('heartbeat', 'progress') THEN lease_owner END AS lease_owner,
       CASE WHEN NOT done THEN leased_until WHEN a IN ('heartbeat', 'progress') THEN CASE WHEN k % 3 < 2 THEN TIMESTAMP '{NOW}' + INTERVAL 60 SECOND ELSE leased_until END END AS leased_until,
       CASE WHEN NOT done OR a IN ('cancel', 'heartbeat', 'progress') THEN last_error WHEN a NOT IN ('succeed', 'retry', 'reset') THEN 'm' || k END AS last_error,
       CASE WHEN done AND a IN ('succeed', 'skip', 'fail') THEN 'n' || k ELSE 'r' || k END AS result_json, CASE WHEN done AND a = 'succeed' AND k % 4 < 2 THEN '/new' WHEN k % 2 = 0 THEN '/o/' || k END AS output_path,
       CASE WHEN NOT done OR a IN ('cancel', 'heartbeat', 'progress', 'manual_review', 'problem_document') THEN 'none' WHEN a IN ('succeed', 'fail') THEN CASE WHEN k % 3 = 1 THEN 'succeeded' END WHEN a = 'skip' THEN 'skipped' WHEN a = 'defer' THEN 'deferred' END AS relay_status FROM after_""",
)
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job after one batch of fenced commands."""
    jobs, _ = state.transition(state_jobs(spark, sf_dir), state_commands(spark, sf_dir), now())
    return jobs.select("job_id", "status", "phase", "attempts", "lease_owner", "leased_until", "last_error", "result_json", "output_path", "relay_status")


@query(
    "job_transition_events",
    STATE_BOTH
    + """, e AS (SELECT k AS job_id, CASE WHEN NOT done THEN CASE WHEN a IN ('succeed', 'skip', 'fail', 'defer', 'manual_review', 'problem_document') THEN 'stale_completion_discarded' WHEN a = 'progress' THEN 'stale_progress_discarded'
         WHEN a = 'retry' AND spent THEN 'retry_rejected_exhausted' END WHEN a = 'cancel' THEN 'cancelled' WHEN a = 'retry' THEN 'retry' WHEN a = 'reset' THEN 'retry_generation_reset' WHEN a = 'progress' THEN 'progress' WHEN a <> 'heartbeat' THEN new_status END AS event FROM after_)
       SELECT job_id, event FROM e WHERE event IS NOT NULL""",
)
def job_transition_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch leaves in the event log, refused commands included."""
    return state.transition(state_jobs(spark, sf_dir), state_commands(spark, sf_dir), now())[1].select("job_id", "event")


@query(
    "ocr_and_html_retries",
    f"""WITH {STATE_JOBS} SELECT k AS job_id, status IN ('failed_retryable', 'failed_final', 'manual_review', 'problem_document', 'cancelled') AS ocr_reset, status IN ('failed_retryable', 'failed_final', 'cancelled', 'needs_chunk_fallback') AS html_reset,
        status IN ('queued', 'failed_retryable', 'manual_review', 'problem_document') AS ocr_cancel, status IN ('queued', 'failed_retryable', 'needs_chunk_fallback') AS html_cancel FROM jobs""",
)
def ocr_and_html_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resets and cancels reach in the other two kinds of queues, each by its own batch."""
    jobs = state_jobs(spark, sf_dir)
    out = jobs.select("job_id")
    for name, queue in (("ocr", state.OCR), ("html", state.HTML)):
        for action, event in (("reset", "retry_generation_reset"), ("cancel", "cancelled")):
            _, events = state.transition(jobs, jobs.select("job_id", F.lit(action).alias("action")), now(), queue)
            hit = events.filter(F.col("event") == event).select("job_id", F.lit(True).alias("hit"))
            out = out.join(hit, "job_id", "left").withColumn(f"{name}_{action}", F.coalesce("hit", F.lit(False))).drop("hit")
    return out


LEASED = f"""WITH {STATE_JOBS}, r AS (SELECT *, status = 'running' AND leased_until < TIMESTAMP '{NOW}' AS over FROM jobs), q AS (SELECT * REPLACE (CASE WHEN over THEN 'queued' ELSE status END AS status) FROM r),
  s AS (SELECT *, status = 'queued' AND max_attempts > 0 AND attempts >= max_attempts AS spent, status = 'queued' AND NOT (max_attempts > 0 AND attempts >= max_attempts) AS open_ FROM q),
  t AS (SELECT *, open_ AND row_number() OVER (PARTITION BY job_type, open_ ORDER BY created_at, k) <= 3 AS taken FROM s)"""


@query("job_leases", LEASED + f"""SELECT k AS job_id, CASE WHEN spent THEN 'failed_final' WHEN taken THEN 'running' ELSE status END AS status, attempts + CAST(taken AS INTEGER) AS attempts, CASE WHEN taken THEN 'worker-9' WHEN NOT over THEN lease_owner END AS lease_owner,
    CASE WHEN taken THEN TIMESTAMP '{NOW}' + INTERVAL 900 SECOND WHEN NOT over THEN leased_until END AS leased_until FROM (SELECT * REPLACE (coalesce(over, false) AS over) FROM t)""")
def job_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after recovery of expired leases, exhaustion, and the lease of three of each type."""
    return state.lease(state_jobs(spark, sf_dir), now(), "worker-9", 900, count=3)[0].select("job_id", "status", "attempts", "lease_owner", "leased_until")


@query("job_lease_events", LEASED + """SELECT k AS job_id, 'recovered' AS event FROM t WHERE over UNION ALL SELECT k, CASE WHEN spent THEN 'attempts_exhausted' ELSE 'leased' END FROM t WHERE spent OR taken""")
def job_lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of that lease."""
    return state.lease(state_jobs(spark, sf_dir), now(), "worker-9", 900, count=3)[1].select("job_id", "event")


@query("orphaned_lease_recovery", f"""WITH {STATE_JOBS} SELECT k AS job_id, CASE WHEN lease_owner = 'w1' THEN 'queued' ELSE status END AS status, CASE WHEN lease_owner <> 'w1' THEN lease_owner END AS lease_owner,
    CASE WHEN lease_owner = 'w1' THEN 'Recovered orphaned job lease.' ELSE last_error END AS last_error FROM jobs""")
def orphaned_lease_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose owner is not alive any more go back to the queue."""
    alive = load(spark, sf_dir, "nation").filter("n_nationkey % 3 <> 1").select(F.concat(F.lit("w"), (F.col("n_nationkey") % 3).cast("string")).alias("owner"))
    return state.recover_orphaned(state_jobs(spark, sf_dir), alive, now())[0].select("job_id", "status", "lease_owner", "last_error")


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = now() + F.make_dt_interval(hours=-(k % 5).cast("int"))
    return load(spark, sf_dir, "customer").select(
        k.alias("run_id"), pick(("running", "stopping", "finished"), k % 3).alias("status"), F.lit("start").alias("phase"), (k % 3 == 1).alias("stop_requested"), F.when(k % 7 == 0, at).alias("finished_at"), at.alias("heartbeat_at"), at.alias("updated_at"),
    )


RUNS = f"""WITH r AS (SELECT c_custkey AS k, ['running', 'stopping', 'finished'][c_custkey % 3 + 1] AS status, c_custkey % 3 = 1 AS stop_requested, TIMESTAMP '{NOW}' - to_hours(CAST(c_custkey % 5 AS INTEGER)) AS at_, c_custkey % 7 = 0 AS over,
  ['heartbeat', 'update', 'finish', 'stop', 'none'][c_custkey % 5 + 1] AS a FROM customer), d AS (SELECT *, status <> 'finished' AND NOT over AND (a IN ('heartbeat', 'update', 'finish') OR a = 'stop' AND (status = 'running' OR NOT stop_requested)) AS done FROM r)"""


def run_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    action = pick(("heartbeat", "update", "finish", "stop", "none"), k % 5)
    return load(spark, sf_dir, "customer").select(k.alias("run_id"), action.alias("action"), F.when(action == "finish", "succeeded").alias("status"), F.when(action == "update", "drain").alias("phase"), F.when(k % 2 == 0, "note").alias("message"))


@query("run_updates", RUNS + f"""SELECT k AS run_id, CASE WHEN done AND a = 'finish' THEN 'succeeded' WHEN done AND a = 'stop' THEN 'stopping' ELSE status END AS status, CASE WHEN done AND a = 'update' THEN 'drain' ELSE 'start' END AS phase,
    stop_requested OR done AND a = 'stop' AS stop_requested, CASE WHEN over THEN at_ WHEN done AND a = 'finish' THEN TIMESTAMP '{NOW}' END AS finished_at, CASE WHEN done THEN TIMESTAMP '{NOW}' ELSE at_ END AS heartbeat_at FROM d""")
def run_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after heartbeats, updates, ends and stop requests."""
    return state.run_changes(run_rows(spark, sf_dir), run_commands(spark, sf_dir), now())[0].drop("updated_at")


@query("run_events", RUNS + "SELECT k AS run_id, CASE a WHEN 'stop' THEN 'stop_requested' WHEN 'finish' THEN 'finished' ELSE 'updated' END AS event FROM d WHERE done AND (a IN ('stop', 'finish') OR a = 'update' AND k % 2 = 0)")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of these changes."""
    return state.run_changes(run_rows(spark, sf_dir), run_commands(spark, sf_dir), now())[1].select("run_id", "event")


@query(
    "event_append",
    """WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS n, event_id % 3 <> 0 AS old FROM events WHERE user_id % 2 = 0),
       l AS (SELECT user_id, max(event_id) AS last_ FROM events WHERE event_id % 3 <> 0 GROUP BY 1), w AS (SELECT user_id, event_type, ts, CAST(event_id AS VARCHAR) AS message FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0)
       SELECT w.user_id, message, coalesce(last_, 0) + row_number() OVER (PARTITION BY w.user_id ORDER BY ts, event_type, message) AS event_id FROM w LEFT JOIN l USING (user_id)""",
)
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events of known entities, numbered behind the last of each."""
    e = load(spark, sf_dir, "events")
    new = e.filter("event_id % 3 = 0").select("user_id", F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("message"), F.col("ts").alias("created_at"))
    known = e.filter("user_id % 2 = 0").select("user_id").distinct()
    return state.append_events(e.filter("event_id % 3 <> 0").select("user_id", "event_id"), new, known, "user_id").select("user_id", "message", "event_id")


@query("last_events_of_a_run", "SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY event_id DESC LIMIT 100")
def last_events_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred events of one run, a page of its history."""
    e = load(spark, sf_dir, "events")
    return state.latest_events(e, F.col("user_id") == e.agg(F.min("user_id")).scalar()).select("event_id", "event_type")


@query(
    "event_log_after_pruning",
    """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE NOT (rn > 5 AND ts < (SELECT max(ts) FROM events) - INTERVAL 14 DAY)""",
)
def event_log_after_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after retention: recent events, and the newest of each entity."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("created_at"))
    return state.prune(e, e.agg(F.max("created_at")).scalar(), "user_id", keep=5).select("event_id")


@query("table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a store."""
    return state.counts_of({name: load(spark, sf_dir, name) for name in ("orders", "lineitem", "events")})


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    at = now() - F.make_dt_interval(days=F.lit(3))
    return load(spark, sf_dir, "part").filter(k % 4 != 0).select(
        k.alias("source_path"), F.col("p_size").cast("long").alias("source_size"), (k % 5).alias("source_mtime_ns"), F.when(k % 3 == 0, 2).cast("int").alias("stable_seen_count"),
        F.when(k % 2 == 0, at).alias("first_seen_at"), at.alias("last_seen_at"), F.lit("known").alias("status"), at.alias("updated_at"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").filter(k % 5 != 1).select(k.alias("source_path"), (F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)).cast("long").alias("source_size"), (k % 5).alias("source_mtime_ns"), F.lit("seen").alias("status"))


@query("file_signature_unchanged", "SELECT p_partkey AS source_path, p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AS unchanged FROM part WHERE p_partkey % 5 <> 1")
def file_signature_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sighted files have the stored signature."""
    return state.unchanged(sightings(spark, sf_dir), stored_files(spark, sf_dir), "source_path").select("source_path", "unchanged")


@query(
    "watched_file_upsert",
    f"""SELECT p_partkey AS source_path, CASE WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 2 END WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END ELSE 1 END AS stable_seen_count,
       CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '{NOW}' WHEN p_partkey % 5 = 1 AND p_partkey % 2 = 1 THEN NULL ELSE TIMESTAMP '{NOW}' - INTERVAL 3 DAY END AS first_seen_at, CASE WHEN p_partkey % 5 = 1 THEN 'known' ELSE 'seen' END AS status
       FROM part WHERE p_partkey % 5 <> 1 OR p_partkey % 4 <> 0""",
)
def watched_file_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched files after a round of sightings."""
    return state.watched(stored_files(spark, sf_dir), sightings(spark, sf_dir), now()).select("source_path", "stable_seen_count", "first_seen_at", "status")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = now() - F.make_dt_interval(days=(k % 9 + 1).cast("int"))
    return load(spark, sf_dir, "supplier").filter(k % 3 != 0).select(k.alias("source_path"), pick(("too_large", "encrypted", "broken"), k % 3).alias("problem_status"), F.lit("old").alias("reason"), at.alias("first_seen_at"), at.alias("last_seen_at"), F.when(k % 2 == 0, at).alias("resolved_at"))


def problem_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems after new findings and then resolutions."""
    s = load(spark, sf_dir, "supplier")
    found = s.filter("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("source_path"), F.lit("broken").alias("problem_status"), F.lit("new").alias("reason"))
    solved = s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("source_path"), F.lit("fixed").alias("reason"))
    return state.resolve_problems(state.record_problems(problems(spark, sf_dir), found, now()), solved, now())


PROBLEMS = f"""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 <> 0 AS had, s_suppkey % 4 <> 1 AS found, TIMESTAMP '{NOW}' - to_days(CAST(s_suppkey % 9 + 1 AS INTEGER)) AS at_ FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 4 <> 1),
  o AS (SELECT *, k % 5 = 0 AND (found OR k % 2 = 1) AS fixed FROM s),
  p AS (SELECT k AS source_path, CASE WHEN found THEN 'broken' ELSE ['too_large', 'encrypted', 'broken'][k % 3 + 1] END AS problem_status, CASE WHEN fixed THEN 'fixed' WHEN found THEN 'new' ELSE 'old' END AS reason, CASE WHEN had THEN at_ ELSE TIMESTAMP '{NOW}' END AS first_seen_at,
    CASE WHEN found OR fixed THEN TIMESTAMP '{NOW}' ELSE at_ END AS last_seen_at, CASE WHEN fixed THEN TIMESTAMP '{NOW}' WHEN found THEN NULL WHEN k % 2 = 0 THEN at_ END AS resolved_at FROM o)"""


@query("problem_document_upsert", PROBLEMS + " SELECT * FROM p")
def problem_document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem documents: first seen stays, new findings open again, resolutions close."""
    return problem_state(spark, sf_dir)


@query("open_problem_page", PROBLEMS + " SELECT source_path, problem_status FROM p WHERE resolved_at IS NULL AND problem_status IN ('broken', 'encrypted') ORDER BY last_seen_at DESC, source_path LIMIT 100")
def open_problem_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of open problems of two kinds, the last seen first."""
    return state.open_problems(problem_state(spark, sf_dir), ["encrypted", "broken"]).select("source_path", "problem_status")


@query("open_problem_counts", PROBLEMS + " SELECT coalesce(problem_status, 'total') AS problem_status, count(*) AS n FROM p WHERE resolved_at IS NULL GROUP BY ROLLUP (problem_status)")
def open_problem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open problems by status, and their total."""
    return state.problem_summary(problem_state(spark, sf_dir))


@query(
    "maintenance_cursors",
    f"""SELECT n_name AS maintenance_key, CASE WHEN n_regionkey = 1 THEN TIMESTAMP '{NOW}' + CASE WHEN n_nationkey % 2 = 0 THEN INTERVAL 60 SECOND ELSE INTERVAL 3600 SECOND END ELSE TIMESTAMP '{NOW}' - to_hours(CAST(n_nationkey - 12 AS INTEGER)) END AS next_run_at,
       n_regionkey <> 1 AND n_nationkey >= 12 OR n_regionkey = 4 AS due FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT n_name, NULL, true FROM nation WHERE n_regionkey = 4""",
)
def maintenance_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors after some tasks were done, and which tasks are due; those without a cursor are."""
    n = load(spark, sf_dir, "nation")
    stored = n.filter("n_regionkey <> 4").select(F.col("n_name").alias("maintenance_key"), (now() - F.make_dt_interval(hours=(F.col("n_nationkey") - 12).cast("int"))).alias("next_run_at"), F.lit("{}").alias("payload"), now().alias("updated_at"))
    done = n.filter("n_regionkey = 1").select(F.col("n_name").alias("maintenance_key"), F.lit('{"deleted": 1}').alias("payload"), (F.col("n_nationkey") % 2 == 0).alias("has_more"))
    cursors = state.maintenance(stored, done, now())
    keys = n.select(F.col("n_name").alias("maintenance_key"))
    due = state.due(keys, cursors, now()).withColumn("due", F.lit(True))
    return keys.join(cursors, "maintenance_key", "left").join(due, "maintenance_key", "left").select("maintenance_key", "next_run_at", F.coalesce("due", F.lit(False)).alias("due"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored results: JSON objects, some compacted, some of open jobs."""
    d, k = load(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("ok")))
    result = F.when(k % 6 == 0, F.concat(F.lit('{"_compacted":'), body, F.lit("}"))).when(k % 6 != 1, body)
    return d.select(k.alias("job_id"), pick(("succeeded", "skipped", "failed_final", "running"), k % 4).alias("status"), result.alias("result_json"), F.octet_length(F.coalesce("text", F.lit(""))).alias("octets"))


@query("stored_result_metrics", "SELECT count(*) AS n_rows, count(*) FILTER (doc_id % 6 = 0) AS compacted_rows FROM documents WHERE doc_id % 6 <> 1")
def stored_result_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and compacted ones of the stored results."""
    return state.result_metrics(stored_results(spark, sf_dir)).select("n_rows", "compacted_rows")


@query("result_compaction_candidates", "SELECT doc_id AS job_id FROM documents WHERE doc_id % 4 < 3 AND doc_id % 6 NOT IN (0, 1) AND strlen(text) > 9000 AND NOT regexp_matches(text, '[\"\\\\\\x00-\\x1f/]')")
def result_compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs with large results, of texts that JSON writes as they are."""
    rows = state.compaction_candidates(stored_results(spark, sf_dir), 9000 + len('{"text":"","ok":true}'))
    plain = load(spark, sf_dir, "documents").filter(~F.col("text").rlike(r'["\\\x00-\x1f/]')).select(F.col("doc_id").alias("job_id"))
    return rows.join(plain, "job_id", "left_semi").select("job_id")


@query("result_compaction_totals")
def result_compaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compaction saves; only rows above the limit go to Python."""
    return state.compact_results(stored_results(spark, sf_dir), compact_json)[1]


@query(
    "library_alias_filters",
    """WITH l AS (SELECT s_suppkey, 'lib' || s_suppkey AS library_id, s_nationkey FROM supplier), a AS (SELECT library_id, library_id AS alias FROM l UNION SELECT l.library_id, n.n_name FROM l JOIN nation n ON l.s_nationkey = n.n_nationkey)
       SELECT DISTINCT library_id, key AS parent_key FROM (SELECT library_id, unnest(CASE alias WHEN 'FRANCE' THEN ['P1', 'P2'] WHEN 'lib5' THEN ['P9'] WHEN 'lib7' THEN ['P9', 'P8'] ELSE [] END) AS key FROM a)""",
)
def library_alias_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent keys that a filter by library aliases allows; folders are compared as paths."""
    configs = load(spark, sf_dir, "supplier").select(F.concat(F.lit("lib"), F.col("s_suppkey")).alias("library_id"), F.concat(F.lit("C:\\Data\\"), F.col("s_nationkey"), F.lit("\\")).alias("data_dir"))
    bindings = load(spark, sf_dir, "nation").select(F.col("n_name").alias("binding_id"), F.concat(F.lit("c:/data//"), F.col("n_nationkey")).alias("data_dir"))
    keys = {"FRANCE": ["P1", " P2 ", ""], "lib5": ["P9"], "lib7": ["P9", "P8", "P9"]}
    filters = F.create_map(*[x for name, values in keys.items() for x in (F.lit(name), F.array(*map(F.lit, values)))])
    return state.allowed_parents(state.library_aliases(configs, bindings), filters)


@query("scan_result_window", "SELECT count(*) AS scanned, greatest(count(*) - 1000, 0) AS omitted FROM orders")
def scan_result_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results a scan has, and how many its report leaves out."""
    return state.result_window(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])[1]

"""Job queue queries over stand-ins: orders are jobs, events and conversations are event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import jobs, pipelines, state
from ..sources.tables import load
from .registry import query


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: six statuses by key, attempts and budgets, leases and errors."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed_retryable", "failed_final", "skipped", "cancelled"))), (k % 7 + 1).cast("int"))
    error = F.when(k % 5 == 0, F.concat(F.lit("HTTP 50"), (k % 3 + 1).cast("string"))).when(k % 5 == 1, "Connection reset by peer").when(k % 5 == 2, "parse error").otherwise("")
    return o.select(
        k.alias("job_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("library_id"), status.alias("status"), (k % 4).cast("int").alias("attempts"),
        (k % 5 - 1).cast("int").alias("max_attempts"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 15)")).alias("leased_until"), error.alias("last_error"),
    )


JOBS = """
WITH jobs AS (
  SELECT o_orderkey AS job_id, o_orderpriority AS job_type, o_custkey AS library_id,
         ['queued', 'running', 'succeeded', 'failed_retryable', 'failed_final', 'skipped', 'cancelled'][o_orderkey % 7 + 1] AS status,
         CAST(o_orderkey % 4 AS INTEGER) AS attempts, CAST(o_orderkey % 5 - 1 AS INTEGER) AS max_attempts, o_orderdate AS created_at, o_orderdate + INTERVAL 15 MINUTE AS leased_until,
         CASE o_orderkey % 5 WHEN 0 THEN 'HTTP 50' || (o_orderkey % 3 + 1) WHEN 1 THEN 'Connection reset by peer' WHEN 2 THEN 'parse error' ELSE '' END AS last_error
  FROM orders
)
"""
BUDGET = "(max_attempts <= 0 OR attempts < max_attempts)"
#: HTTP 501 is not an error that passes.
PASSING = "(last_error IN ('HTTP 502', 'HTTP 503') OR last_error LIKE 'Connection reset%')"
COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in jobs.STATUSES)


@query("queue_status_summary", JOBS + f"SELECT job_type, {COUNTS}, count(*) FILTER (status = 'failed_final' AND {PASSING}) AS failed_transient, count(*) AS total FROM jobs GROUP BY 1")
def queue_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-filled status counts of each queue."""
    return jobs.queue_summary(order_jobs(spark, sf_dir), ["job_type"])


@query("queue_summary_scoped", JOBS + f"SELECT {COUNTS}, count(*) FILTER (status = 'failed_final' AND {PASSING}) AS failed_transient, count(*) AS total FROM jobs WHERE library_id IN (1, 2, 3, 5, 8) AND job_type = '1-URGENT'")
def queue_summary_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of some libraries and one job type."""
    return jobs.queue_summary(order_jobs(spark, sf_dir).filter(F.col("library_id").isin(1, 2, 3, 5, 8) & (F.col("job_type") == "1-URGENT")))


@query("transient_failure_count", JOBS + f"SELECT library_id, count(*) AS n FROM jobs WHERE status = 'failed_final' AND {PASSING} GROUP BY 1")
def transient_failure_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final failures whose error passes by itself, by library."""
    return order_jobs(spark, sf_dir).filter((F.col("status") == "failed_final") & jobs.is_transient(F.col("last_error"))).groupBy("library_id").agg(F.count(F.lit(1)).alias("n"))


@query("job_page", JOBS + "SELECT job_id, status, created_at FROM jobs WHERE status IN ('failed_final', 'failed_retryable') ORDER BY created_at, job_id LIMIT 50 OFFSET 20")
def job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of failed jobs, oldest first."""
    return jobs.page(order_jobs(spark, sf_dir), ["failed"], 50, 20).select("job_id", "status", "created_at")


@query("fifo_lease_next", JOBS + f"SELECT job_type, job_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY created_at, job_id) AS rn FROM jobs WHERE status = 'queued' AND {BUDGET}) WHERE rn = 1")
def fifo_lease_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next job of each queue."""
    return jobs.lease_next(order_jobs(spark, sf_dir)).select("job_type", "job_id", "created_at")


@query("exhausted_attempts", JOBS + f"SELECT job_id, CASE WHEN status = 'queued' AND NOT {BUDGET} THEN 'failed_final' ELSE status END AS status FROM jobs")
def exhausted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued jobs without attempts left become failures."""
    return jobs.exhaust(order_jobs(spark, sf_dir)).select("job_id", "status")


@query("expired_lease_recovery", JOBS + "SELECT job_id, CASE WHEN e THEN 'queued' ELSE status END AS status, e AS recovered FROM (SELECT *, status = 'running' AND leased_until < TIMESTAMP '1996-01-01' AS e FROM jobs)")
def expired_lease_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease is over at a given time go back to the queue."""
    return jobs.recover_expired(order_jobs(spark, sf_dir), F.lit("1996-01-01").cast("timestamp_ntz")).select("job_id", "status", "recovered")


@query(
    "attempt_budget_transition",
    JOBS
    + f"""SELECT job_id, CASE WHEN job_id % 2 = 0 AND {BUDGET} THEN 'failed_retryable' ELSE 'failed_final' END AS failed,
       CASE WHEN status IN ('failed_retryable', 'failed_final', 'skipped', 'cancelled') AND {BUDGET} THEN 'queued' ELSE status END AS retried,
       CASE WHEN status IN ('failed_retryable', 'failed_final', 'skipped', 'cancelled') THEN 'queued' ELSE status END AS reset,
       CASE WHEN status IN ('queued', 'failed_retryable', 'skipped') THEN 'cancelled' ELSE status END AS cancelled FROM jobs""",
)
def attempt_budget_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failing, retrying, resetting and cancelling make of each job."""
    s, a, m = F.col("status"), F.col("attempts"), F.col("max_attempts")
    return order_jobs(spark, sf_dir).select(
        "job_id", jobs.failed_status(F.col("job_id") % 2 == 0, a, m).alias("failed"), jobs.retried_status(s, a, m).alias("retried"),
        jobs.retried_status(s, a, m, reset=True).alias("reset"), jobs.cancelled_status(s).alias("cancelled"),
    )


@query(
    "parent_scope_status_rank",
    JOBS
    + """SELECT library_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 WHEN 'failed_retryable' THEN 2
       WHEN 'succeeded' THEN 3 WHEN 'failed_final' THEN 4 ELSE 5 END, created_at DESC, job_id) AS rn FROM jobs) WHERE rn = 1""",
)
def parent_scope_status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that stands for a library."""
    return jobs.best_by_status(order_jobs(spark, sf_dir), ["library_id"]).select("library_id", "job_id", "status")


@query(
    "dedupe_key_enqueue",
    """WITH e AS (SELECT *, 'job:' || user_id || ':' || event_type || ':' || event_id % 9 AS dedupe_key FROM events), old AS (SELECT DISTINCT dedupe_key FROM e WHERE event_id < (SELECT max(event_id) / 2 FROM events)),
       new AS (SELECT * FROM e WHERE event_id >= (SELECT max(event_id) / 2 FROM events))
       SELECT dedupe_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY event_id) AS rn FROM new) WHERE rn = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM old)""",
)
def dedupe_key_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the later half of the log that the earlier half has not enqueued."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    middle = e.agg(F.max("event_id") / 2).scalar()
    e = e.withColumn("dedupe_key", jobs.dedupe_key("job", F.col("user_id"), F.col("event_type"), F.col("event_id") % 9))
    new, old = e.filter(F.col("event_id") >= middle), e.filter(F.col("event_id") < middle)
    return jobs.enqueue(new, old, order="event_id").select("dedupe_key", "event_id")


@query("latest_state_from_events", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_state_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each entity from its log."""
    return jobs.latest(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query(
    "event_retention",
    """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
       WHERE rn > 20 AND ts < (SELECT max(ts) - INTERVAL 14 DAY FROM events)""",
)
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beyond the retention that are not among the newest of their entity."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    cutoff = e.agg(F.max("ts") - F.expr("INTERVAL 14 DAY")).scalar()
    return jobs.prunable(e, "user_id", "event_id", "ts", cutoff, 20).select("event_id", "user_id")


@query(
    "stable_seen_count",
    """WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
       SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS INTEGER) AS stable_seen_count FROM r""",
)
def stable_seen_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often in a row each entity was seen unchanged."""
    return jobs.stable_seen(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", ["event_type"]).select("event_id", "stable_seen_count")


@query(
    "single_active_run",
    """WITH r AS (SELECT event_id AS run_id, event_type, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'stopping' ELSE 'finished' END AS status FROM events),
       f AS (SELECT *, status IN ('running', 'stopping') AND abs(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) <= 1000000 AS fresh FROM r),
       n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fresh DESC, ts DESC, run_id DESC) AS rn FROM f)
       SELECT run_id, CASE WHEN status IN ('running', 'stopping') AND NOT (fresh AND rn = 1) THEN 'interrupted' ELSE status END AS status FROM n""",
)
def single_active_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's active runs the freshest stays, if it is fresh."""
    e = load(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "stopping").otherwise("finished")
    runs = e.select(F.col("event_id").alias("run_id"), "user_id", F.col("ts").alias("heartbeat_at"), status.alias("status"))
    return jobs.single_active(runs, F.lit("2024-02-01").cast("timestamp_ntz"), 1_000_000, ["user_id"]).select("run_id", "status")


@query(
    "problem_summary_rollup",
    "SELECT coalesce(event_type, 'total') AS problem_status, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY ROLLUP (event_type)",
)
def problem_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open problems by status, with their total."""
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("problem_status"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("resolved_at"))
    return state.problem_summary(rows)


@query(
    "result_size_metrics",
    "SELECT count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(strlen(text)) AS max_bytes, count(*) FILTER (text LIKE 'The%') AS compacted_rows FROM documents WHERE text IS NOT NULL",
)
def result_size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, octets and the largest of stored results."""
    d = load(spark, sf_dir, "documents").filter("text is not null")
    size = F.octet_length("text").cast("long")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("bytes"), F.max(size).alias("max_bytes"), F.count_if(F.col("text").startswith("The")).alias("compacted_rows"))


@query(
    "oversize_results",
    "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) > 4000 ORDER BY doc_id LIMIT 100",
)
def oversize_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest results above a size, one batch."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return d.filter("bytes > 4000").orderBy("doc_id").limit(100)


@query(
    "event_table_counts",
    "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels",
)
def event_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each event table."""
    return state.counts_of({t: load(spark, sf_dir, t) for t in ("events", "conversations", "labels")})


@query(
    "batch_rollup",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS processed, count(*) FILTER (event_type IN ('error', 'refund')) AS failed, count(*) FILTER (value > 50) AS html_found,
       count(DISTINCT user_id) AS users, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""",
)
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each day's batch."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return e.groupBy("day").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("event_type").isin("error", "refund")).alias("failed"), F.count_if(F.col("value") > 50).alias("html_found"),
        F.countDistinct("user_id").alias("users"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
    )


@query(
    "running_failure_threshold",
    """WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS processed, count(*) FILTER (event_id % 9 = 0) AS failed FROM events GROUP BY 1)
       SELECT day, CAST(sum(processed) OVER w AS BIGINT) AS total_processed, CAST(sum(failed) OVER w AS BIGINT) AS total_failed, sum(failed) OVER w >= 400 AS stop FROM d WINDOW w AS (ORDER BY day)""",
)
def running_failure_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over batches, and when they stop the drain: one row a day, aggregated before the order."""
    d = load(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("event_id") % 9 == 0).alias("failed"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("failed").over(w)
    return d.select("day", F.sum("processed").over(w).alias("total_processed"), total.alias("total_failed"), (total >= 400).alias("stop"))


@query(
    "ready_ingest_actions",
    JOBS
    + """, q AS (SELECT library_id, count(*) FILTER (status = 'queued' AND job_type = '1-URGENT') > 0 AS a, count(*) FILTER (status = 'queued' AND job_type = '2-HIGH') > 0 AS b,
       count(*) FILTER (status = 'running') > 0 AS c FROM jobs GROUP BY 1)
       SELECT library_id, concat_ws(',', CASE WHEN a THEN 'metadata' END, CASE WHEN b THEN 'arxiv_html' END, CASE WHEN c THEN 'full_text' END) AS actions,
       CASE WHEN a THEN 'metadata' WHEN b THEN 'arxiv_html' WHEN c THEN 'full_text' END AS next_action FROM q""",
)
def ready_ingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues that are ready, in their fixed order, and the first of them."""
    queued = lambda t: (F.col("status") == "queued") & (F.col("job_type") == t)
    q = order_jobs(spark, sf_dir).groupBy("library_id").agg((F.count_if(queued("1-URGENT")) > 0).alias("a"), (F.count_if(queued("2-HIGH")) > 0).alias("b"), (F.count_if(F.col("status") == "running") > 0).alias("c"))
    rows = pipelines.next_action(q, {"metadata": F.col("a"), "arxiv_html": F.col("b"), "full_text": F.col("c")})
    return rows.select("library_id", F.array_join("actions", ",").alias("actions"), "next_action")


@query(
    "upsert_last_write",
    """WITH b AS (SELECT c_custkey AS k, 0 AS version, c_name AS v FROM customer), c AS (SELECT o_custkey AS k, CAST(epoch(o_orderdate) AS BIGINT) AS version, 'order ' || o_orderkey AS v FROM orders),
       l AS (SELECT k, version, max(v) AS v FROM c GROUP BY 1, 2), u AS (SELECT *, 0 AS n FROM b UNION ALL SELECT *, 1 FROM l)
       SELECT k, version, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, n DESC) AS rn FROM u) WHERE rn = 1""",
)
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed upsert: the last write of each key holds."""
    base = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("version"), F.col("c_name").alias("v"))
    o = load(spark, sf_dir, "orders")
    change = o.groupBy(F.col("o_custkey").alias("k"), F.unix_timestamp("o_orderdate").alias("version")).agg(F.max(F.concat(F.lit("order "), F.col("o_orderkey"))).alias("v"))
    return jobs.latest_upsert(base, change, ["k"], "version").select("k", "version", "v")


@query(
    "relay_status_json",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'dry_run' WHEN 3 THEN 'skipped' WHEN 4 THEN 'invalid' END AS status FROM events""",
)
def relay_status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status in a relay's JSON answer, by exact booleans."""
    k = F.col("event_id") % 6
    payload = F.when(k == 0, '{"ok": true, "dryRun": false}').when(k == 1, '{"ok": false}').when(k == 2, '{"ok": true, "dryRun": true}').when(k == 3, '{"ok": true, "skipped": true}').when(k == 4, '{"ok": "yes"}')
    return load(spark, sf_dir, "events").select("event_id", jobs.relay_status(payload).alias("status"))

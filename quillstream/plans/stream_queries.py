"""Streaming twins of the batch queries, drained to the end and compared with the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import dedupe_key
from ..sources.tables import load
from ..streaming import controller
from ..streaming import jobs as streams
from ..workspace import scratch
from .registry import query


@query("stream_enqueue_dedupe", "SELECT DISTINCT user_id || ':' || event_type AS dedupe_key FROM events")
def stream_enqueue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an idempotent intake lets through."""
    events = streams.event_stream(spark, sf_dir).withColumn("dedupe_key", dedupe_key(F.col("user_id"), F.col("event_type")))
    return streams.drain(streams.enqueue(events).select("dedupe_key"))


@query("stream_status_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of each day."""
    counts = streams.status_counts(streams.event_stream(spark, sf_dir).withColumnRenamed("event_type", "status"))
    out = streams.drain(counts, "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "status", "n")


@query(
    "stream_lease_states",
    """WITH l AS (SELECT user_id AS job_id, arg_max(CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' ELSE 'failed' END, (ts, event_id)) AS status, max(ts) AS at_ FROM events GROUP BY 1)
       SELECT job_id, CASE WHEN status = 'running' AND at_ + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) THEN 'queued' ELSE status END AS status FROM l""",
)
def stream_lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each job behind four batches of events; leases that time has passed are queued again."""
    event = F.when(F.col("event_id") % 3 == 0, "leased").when(F.col("event_id") % 3 == 1, "succeeded").otherwise("failed")
    rows = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), event.alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    updates = streams.drain(streams.leases(streams.replayed(spark, rows, "event_id", 4), 7200), "update")
    return streams.latest_of(updates, "job_id").select("job_id", "status")


JOB = "job_id long, dedupe_key string, status string, phase string, attempts int, max_attempts int, lease_owner string, leased_until timestamp_ntz, last_error string, created_at timestamp_ntz, updated_at timestamp_ntz"


def _controlled(spark: SparkSession, sf_dir: str) -> controller.Store:
    """Four batches of events through the controller: purchases make jobs, errors cancel them, the others retry them."""
    now = lambda number: F.lit("2024-06-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(number))
    e = load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("job_id"), "event_type", F.when(F.col("event_type") == "purchase", F.concat(F.lit("job:"), F.col("user_id"))).alias("dedupe_key"), F.lit("queued").alias("status"), F.lit("queued").alias("phase"),
        F.lit(0).alias("attempts"), F.lit(0).alias("max_attempts"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    store = controller.Store(spark, scratch(spark, "controller"), JOB)

    def commands(batch: DataFrame, jobs: DataFrame) -> DataFrame:
        return batch.filter("event_type <> 'purchase'").select(F.col("event_id").alias("turn"), "job_id", F.when(F.col("event_type") == "error", "cancel").otherwise("retry").alias("action"))

    controller.run_until_drained(streams.replayed(spark, e, "event_id", 4), store, controller.step(store, now, commands))
    return store


#: A job is there once its first purchase is in the batch or before it; of its commands since then the last decides.
CONTROLLED = """WITH b AS (SELECT *, (event_id - (SELECT min(event_id) FROM events)) // (((SELECT max(event_id) - min(event_id) FROM events) // 4) + 1) AS batch FROM events),
  j AS (SELECT user_id, min(batch) AS first_ FROM b WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT b.user_id, arg_max(event_type, event_id) AS last_ FROM b JOIN j USING (user_id) WHERE event_type <> 'purchase' AND batch >= first_ GROUP BY 1)
"""


@query("stream_controller", CONTROLLED + "SELECT user_id AS job_id, CASE WHEN last_ = 'error' THEN 'cancelled' ELSE 'queued' END AS status FROM j LEFT JOIN c USING (user_id)")
def stream_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs behind a controller's batches of intake and commands."""
    return _controlled(spark, sf_dir).version(3).select("job_id", "status")


@query(
    "stream_controller_events",
    CONTROLLED
    + """, s AS (SELECT b.user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e FROM b JOIN j USING (user_id) WHERE event_type <> 'purchase' AND batch >= first_),
         t AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM s)
       SELECT user_id AS job_id, count(*) FILTER (e = 1 AND before = 0) AS cancelled, count(*) FILTER (e = 0 AND before = 1) AS retried FROM t GROUP BY 1 HAVING count(*) FILTER (e <> before) > 0""",
)
def stream_controller_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the controller's commands left in the log: only those that changed a job."""
    log = _controlled(spark, sf_dir).events()
    return log.groupBy("job_id").agg(F.count_if(F.col("event") == "cancelled").alias("cancelled"), F.count_if(F.col("event") == "retry").alias("retried"))

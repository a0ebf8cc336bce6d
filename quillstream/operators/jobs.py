"""Durable job queues as queries over job and event tables.

Jobs are rows and changes are new versions of rows: every operator takes a DataFrame of jobs and gives one
back, so a micro-batch can apply it and write the result.  Column names: job_id, job_type, library_id,
status, attempts, max_attempts, lease_owner, leased_until, created_at, updated_at, last_error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Job statuses, and marks of errors that pass by themselves.
STATUSES = ("queued", "running", "succeeded", "skipped", "failed_retryable", "failed_final", "cancelled")
RETRIED = ("failed_retryable", "failed_final", "skipped", "cancelled")
CANCELLED_FROM = ("queued", "failed_retryable", "skipped")
STATUS_RANK = ("queued", "running", "failed_retryable", "succeeded", "failed_final")
TRANSIENT = (
    "http 408", "http 409", "http 425", "http 429", "http 500", "http 502", "http 503", "http 504", "timed out", "timeout",
    "getaddrinfo failed", "connection refused", "connection reset", "winerror 10054", "winerror 10060", "удаленный хост принудительно разорвал",
    "попытка установить соединение", "temporary failure", "temporarily unavailable", "too many requests",
)


def dedupe_key(*parts: Column | str) -> Column:
    """Parts joined by colons; nulls are empty."""
    return F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def safe_job_type(value: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("job")), r"(?U)[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("job"))


def within_budget(attempts: Column, most: Column) -> Column:
    """Whether another attempt is allowed; a budget of 0 or less has no end."""
    return (most <= 0) | (attempts < most)


def is_transient(error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    found = F.lit(False)
    for mark in TRANSIENT:
        found = found | F.contains(text, F.lit(mark))
    return found


def enqueue(new: DataFrame, existing: DataFrame, key: str = "dedupe_key", order: str = "created_at") -> DataFrame:
    """Jobs whose key is neither in `existing` nor on an earlier new row."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(existing.select(key).distinct(), key, "left_anti").select(new.columns)


def queue_summary(jobs: DataFrame, by: Sequence[str] = (), statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Counts of every known status (0 where none), of transient final failures, and of all jobs."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    transient = F.count_if((F.col("status") == "failed_final") & is_transient(F.col("last_error"))).alias("failed_transient")
    return jobs.groupBy(*by).agg(*counts, transient, F.count(F.lit(1)).alias("total"))


def status_filter(statuses: Sequence[str]) -> Column:
    """Status in a list; `failed` stands for both kinds of failure."""
    wanted = {s for s in statuses if s != "failed"} | ({"failed_final", "failed_retryable"} if "failed" in statuses else set())
    return F.col("status").isin(*sorted(wanted)) if wanted else F.lit(True)


def page(jobs: DataFrame, statuses: Sequence[str] = (), limit: int = 0, offset: int = 0) -> DataFrame:
    """One page of a queue, oldest first."""
    out = jobs.filter(status_filter(statuses)).orderBy("created_at", "job_id").offset(offset)
    return out.limit(limit) if limit > 0 else out


def exhaust(jobs: DataFrame) -> DataFrame:
    """Queued jobs without attempts left become final failures."""
    spent = (F.col("status") == "queued") & ~within_budget(F.col("attempts"), F.col("max_attempts"))
    return jobs.withColumn("status", F.when(spent, "failed_final").otherwise(F.col("status")))


def lease_next(jobs: DataFrame, per: str = "job_type", count: int = 1) -> DataFrame:
    """The oldest queued jobs with attempts left, `count` of each type; ties go to the smaller id."""
    open_ = jobs.filter((F.col("status") == "queued") & within_budget(F.col("attempts"), F.col("max_attempts")))
    order = Window.partitionBy(per).orderBy("created_at", "job_id")
    return open_.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count).drop("_n")


def recover_expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over go back to the queue."""
    over = F.coalesce((F.col("status") == "running") & (F.col("leased_until") < now), F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(over, "queued").otherwise(F.col("status")), "recovered": over,
            "leased_until": F.when(~over, F.col("leased_until")),
        }
    )


def holds_lease(owner: str, now: Column, attempt: Column) -> Column:
    """Fencing: the job still runs under this owner, this attempt and an unexpired lease."""
    return (F.col("status") == "running") & (F.col("lease_owner") == owner) & (F.col("leased_until") >= now) & (F.col("attempts") == attempt)


def failed_status(retryable: Column, attempts: Column, most: Column) -> Column:
    return F.when(retryable & within_budget(attempts, most), "failed_retryable").otherwise("failed_final")


def retried_status(status: Column, attempts: Column, most: Column, reset: bool = False) -> Column:
    """What a retry makes of a status: queued where it is allowed; a reset ignores the budget."""
    allowed = status.isin(*RETRIED) & (F.lit(True) if reset else within_budget(attempts, most))
    return F.when(allowed, "queued").otherwise(status)


def cancelled_status(status: Column) -> Column:
    return F.when(status.isin(*CANCELLED_FROM), "cancelled").otherwise(status)


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUS_RANK))
    for rank, name in enumerate(STATUS_RANK):
        out = F.when(status == name, rank).otherwise(out)
    return out


def best_by_status(jobs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One job for each scope: by rank of its status, then the latest created, then the smaller id."""
    order = Window.partitionBy(*scope).orderBy(status_rank(F.col("status")), F.col("created_at").desc(), "job_id")
    return jobs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def latest(events: DataFrame, entity: str, seq: str) -> DataFrame:
    """The last event of each entity."""
    order = Window.partitionBy(entity).orderBy(F.col(seq).desc())
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def prunable(events: DataFrame, entity: str, seq: str, at: str, cutoff: Column, keep: int) -> DataFrame:
    """Events older than the cutoff that are not among the newest `keep` of their entity."""
    order = Window.partitionBy(entity).orderBy(F.col(seq).desc())
    ranked = events.withColumn("_n", F.row_number().over(order))
    return ranked.filter((F.col(at) < cutoff) & (F.col("_n") > keep)).drop("_n")


def stable_seen(events: DataFrame, entity: str, seq: str, signature: Sequence[str]) -> DataFrame:
    """How often in a row each sighting of a file has had the same signature."""
    order = Window.partitionBy(entity).orderBy(seq)
    same = F.lit(True)
    for c in signature:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    changed = events.withColumn("_new", F.when(same & F.lag(seq).over(order).isNotNull(), 0).otherwise(1))
    runs = changed.withColumn("_run", F.sum("_new").over(order))
    return runs.withColumn("stable_seen_count", F.row_number().over(Window.partitionBy(entity, "_run").orderBy(seq))).drop("_new", "_run")


def single_active(runs: DataFrame, now: Column, stale_seconds: int, group: Sequence[str] = ()) -> DataFrame:
    """Keep the active run with the freshest heartbeat, if that is fresh; the others are interrupted."""
    active = F.col("status").isin("running", "stopping")
    fresh = active & (F.abs(F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at")) <= stale_seconds)
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("fresh").desc(), F.col("heartbeat_at").desc(), F.col("run_id").desc())
    ranked = runs.withColumn("fresh", F.coalesce(fresh, F.lit(False))).withColumn("_n", F.row_number().over(order))
    kept = F.col("fresh") & (F.col("_n") == 1)
    return ranked.withColumn("status", F.when(active & ~kept, "interrupted").otherwise(F.col("status"))).drop("_n", "fresh")


def latest_upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Keyed last-write-wins merge of a table with changes; equal versions go to the change."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def relay_status(payload: Column) -> Column:
    """Status in a relay's JSON answer: only true booleans count; null stays null."""
    v = F.try_parse_json(payload)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    flag = lambda p: F.try_variant_get(v, p, "boolean")
    odd = lambda p: kind(p).isNotNull() & ~kind(p).isin("BOOLEAN", "VOID")
    ok = F.when(kind("$.ok") == "BOOLEAN", flag("$.ok"))
    return (
        F.when(payload.isNull(), F.lit(None).cast("string")).when(v.isNull() | ok.isNull(), "invalid").when(~ok, "failed")
        .when(odd("$.dryRun"), "invalid").when(flag("$.dryRun"), "dry_run").when(odd("$.skipped"), "invalid").when(flag("$.skipped"), "skipped").otherwise("succeeded")
    )

"""Batches of a drain: totals, limits on failures, and the steps of a controller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state

COUNTED = ("html_found", "html_rejected", "pdf_found", "existing_pdf_html_queued", "existing_pdf_ocr_queued", "translation_queued")


def totals(results: DataFrame, by: Sequence[str], flags: Sequence[str] = COUNTED, sums: Sequence[str] = ("browser_pdf_fallbacks",)) -> DataFrame:
    """Counts of each batch: jobs, failures by kind, flags that hold and sums; missing flags do not hold."""
    status = F.col("status")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(status.isin("failed_retryable", "failed_final")).alias("failed"), F.count_if(status == "failed_retryable").alias("failed_retryable_jobs"),
        F.count_if(status == "failed_final").alias("failed_final_jobs"), *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags],
        *[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in sums],
    )


def valid(batches: DataFrame) -> DataFrame:
    """Adds reason: why a batch result is not to be believed, or null. Its own counts must fit its jobs."""
    reason = (
        F.when(F.col("ok").isNull(), "batch ok must be an exact boolean").when(F.least("processed", "failed") < 0, "batch counts must not be negative")
        .when(F.col("failed") > F.col("processed"), "batch failed count cannot exceed processed count").when(F.col("jobs") != F.col("processed"), "batch results count must equal processed count")
        .when(F.col("failed_retryable_jobs") + F.col("failed_final_jobs") != F.col("failed"), "batch failed count must match failed job statuses")
    )
    return batches.withColumns({"reason": reason, "batch_error": ~F.col("ok") & (F.col("failed") == 0)})


def stop_points(batches: DataFrame, order: Sequence[str], most_failures: int, most_retryable: int, within: Sequence[str] = ()) -> DataFrame:
    """Running failures over the batches of each drain, and whether the drain stops there.

    The order is kept within a drain, so drains are worked side by side; without `within` there is one.
    """
    running = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failed, retryable = F.sum("failed").over(running), F.sum("failed_retryable_jobs").over(running)
    stop = ((F.lit(most_failures) > 0) & (failed >= most_failures)) | ((F.lit(most_retryable) > 0) & (retryable >= most_retryable))
    return batches.withColumns({"total_failed": failed, "total_retryable": retryable, "stop": stop})


def wait_for_host(requests: DataFrame, host: str, at: str, interval: Column, cooldown: Column, status: str = "status") -> DataFrame:
    """Seconds that each request must wait behind the one before to its host: its interval, or a cooldown
    where that one was refused (429 or 503)."""
    order = Window.partitionBy(host).orderBy(at)
    refused = F.coalesce(F.lag(status).over(order).isin(429, 503), F.lit(False))
    gap = F.col(at).cast("timestamp").cast("double") - F.lag(at).over(order).cast("timestamp").cast("double")
    needed = F.when(refused, F.greatest(interval, F.lag(cooldown).over(order))).otherwise(interval)
    return requests.withColumn("wait_seconds", F.greatest(F.lit(0.0), F.coalesce(needed.cast("double") - gap, F.lit(0.0))))


def drain(jobs: DataFrame, now: Column, owner: str, seconds: int, work: Callable[[DataFrame], DataFrame], per: str = "job_type", count: int = 1, queue: state.Queue = state.METADATA) -> tuple[DataFrame, DataFrame]:
    """One round of a drain: lease the oldest jobs, work on them, apply what the work says.

    `work` gets the leased jobs and gives a command for each (see `state.transition`); it runs once for all
    of them, on all executors.  Returns the jobs behind the round and its events; a round that is run again
    from the same jobs gives the same rows.
    """
    leased, events = state.lease(jobs, now, owner, seconds, per, count)
    mine = leased.filter((F.col("status") == "running") & (F.col("lease_owner") == owner.strip()) & (F.col("updated_at") == now))
    after, more = state.transition(leased, work(mine), now, queue)
    return after, events.unionByName(more)


def may_go_on(runs: DataFrame, run: Column, now: Column, stale_seconds: int) -> DataFrame:
    """One row: whether the run is active, asked to stop, and its heartbeat fresh."""
    age = F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at")
    fresh = F.abs(age) <= stale_seconds
    active = F.col("status").isin("running", "stopping") & F.col("finished_at").isNull()
    return runs.filter(run).select("run_id", (active & ~F.col("stop_requested") & F.coalesce(fresh, F.lit(False))).alias("go_on"), "stop_requested")

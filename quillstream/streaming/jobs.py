"""Job queues as streams: idempotent intake, lease expiry, and status counts over time.

Each function turns a streaming DataFrame into another; `drain` runs one to the end of what its source
holds, the bounded form of a polling controller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..workspace import scratch


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The event table as a file stream, its time as a timestamp with watermark-ready type."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(spark: SparkSession, rows: DataFrame, order: str, parts: int) -> DataFrame:
    """A table as a stream of so many micro-batches, in its order: each range of the order is a folder of its own."""
    path = scratch(spark, "replay")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = (high - low) // parts + 1 if low is not None else 1
    for i in range(parts):  # one write after the other, as a file stream goes by the time of its files
        rows.filter((F.col(order) >= (low or 0) + i * width) & (F.col(order) < (low or 0) + (i + 1) * width)).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def enqueue(jobs: DataFrame, key: str = "dedupe_key", at: str = "ts", late: str = "365 days") -> DataFrame:
    """The first job of each key; state is dropped once the watermark has passed it."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def status_counts(jobs: DataFrame, at: str = "ts", width: str = "1 day", late: str = "365 days", slide: str | None = None) -> DataFrame:
    """Counts of each status in tumbling or sliding windows."""
    return jobs.withWatermark(at, late).groupBy(F.window(at, width, slide), "status").agg(F.count(F.lit(1)).alias("n"))


def sessions(jobs: DataFrame, entity: str, at: str = "ts", gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Runs of activity of an entity, ended by a gap."""
    return jobs.withWatermark(at, late).groupBy(F.session_window(at, gap), entity).agg(F.count(F.lit(1)).alias("n"))


def leases(events: DataFrame, seconds: int = 900) -> DataFrame:
    """Status of every job after each batch: a lease that time has passed goes back to queued.

    `events` holds job_id, event (leased, succeeded, failed) and ts.  State is one status and one time a job.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, until = state.get if state.exists else ("queued", 0)
        if state.hasTimedOut:
            status = "queued" if status == "running" else status
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for event, at in zip(rows["event"], rows["ts"]):
                if event == "leased":
                    status, until = "running", int(at.timestamp() * 1000) + seconds * 1000
                elif event in ("succeeded", "failed"):
                    status = event
        state.update((status, until))
        if status == "running" and until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status]})

    return (
        events.withWatermark("ts", "0 seconds").groupBy("job_id")
        .applyInPandasWithState(step, "job_id long, status string", "status string, until long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def drain(stream: DataFrame, mode: str = "append", apply: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream until its source is used up, and return what it wrote.

    With `apply`, each batch goes to that function instead, under an exactly-once batch id.  Update mode
    keeps the latest row of a batch as its own file.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, "stream-out"), scratch(spark, "stream-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if apply is not None:
        writer.foreachBatch(apply).start().awaitTermination()
        return None
    if mode == "append":
        writer.outputMode("append").format("parquet").start(out).awaitTermination()
    else:
        # Batches rewrite the whole result; the batch id in the path makes a repeated batch harmless.
        last: list[int] = []

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            last.append(number)

        writer.outputMode(mode).foreachBatch(write).start().awaitTermination()
        rows = spark.read.parquet(out)
        return rows.filter(F.col("batch") == last[-1]).drop("batch") if mode == "complete" else rows
    return spark.read.schema(stream.schema).parquet(out)


def latest_of(updates: DataFrame, key: str) -> DataFrame:
    """The last row of each key among the batches of a drained update stream."""
    columns = [c for c in updates.columns if c not in (key, "batch")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return last.select(key, "row.*")

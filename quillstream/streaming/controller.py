"""A controller as a stream: each micro-batch of requests is taken in and applied to the stored jobs.

The jobs are versions in a folder, one a batch: a batch reads the version before it and writes its own, so a
batch that is run again writes the same version again.  A stop request is a file in the folder; the
controller looks for it between batches and lets the batch that runs come to its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..operators.jobs import enqueue
from ..workspace import scratch


class Store:
    """Versions of a jobs table and its event log."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, number: int) -> DataFrame:
        """The jobs behind a batch; none before the first."""
        if number < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/jobs/{number}")

    def write(self, number: int, jobs: DataFrame, events: DataFrame) -> None:
        """Write a version whole; the one before the last is not needed any more."""
        jobs.write.mode("overwrite").parquet(f"{self.root}/jobs/{number}")
        events.write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")
        self._files().delete(self._path("jobs", str(number - 2)), True)

    def events(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/events").parquet(f"{self.root}/events")

    def request_stop(self) -> None:
        self._files().create(self._path("stop"), True).close()

    def stop_requested(self) -> bool:
        return self._files().exists(self._path("stop"))


def step(store: Store, now: Callable[[int], Column], work: Callable[[DataFrame, DataFrame], DataFrame], order: str = "created_at", queue: state.Queue = state.METADATA) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: recover expired leases, take in new jobs, apply the commands in turn.

    A batch holds rows with job_id, dedupe_key and the columns of a job; `work` gives the commands of a batch
    on the jobs, with their place in a column `turn`.
    """

    def run(batch: DataFrame, number: int) -> None:
        jobs, at = store.version(number - 1), now(number)
        jobs, events = state.recover_expired(jobs, at)
        fresh = enqueue(batch.filter("dedupe_key is not null").select(*[c for c in jobs.columns if c in batch.columns]), jobs, order=order)
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema.fields if f.name not in fresh.columns]
        jobs = jobs.unionByName(fresh.select("*", *missing).select(jobs.columns))
        jobs, more = state.replay(jobs, work(batch, jobs), at, "turn", queue)
        store.write(number, jobs, events.unionByName(more))

    return run


def run_until_drained(requests: DataFrame, store: Store, batch: Callable[[DataFrame, int], None]) -> int:
    """Run the controller over what its source holds; returns the last version.

    A stop request ends it between two batches: what is left of the source is taken up by the next run.
    """
    last = [-1]

    def guarded(rows: DataFrame, number: int) -> None:
        if store.stop_requested():
            raise StopAsked()
        batch(rows, number)
        last[0] = number

    checkpoint = scratch(requests.sparkSession, "controller-checkpoint")
    stream = requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(guarded).start()
    try:
        stream.awaitTermination()
    except Exception as e:  # the stream wraps what its batch raises
        if "StopAsked" not in str(e):
            raise
    return last[0]


class StopAsked(Exception):
    """A stop request was there before a batch."""

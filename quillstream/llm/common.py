"""Shared pieces: written intermediate tables, Arrow row maps, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import scratch

#: Words of a text: maximal runs of anything but space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Session, path and thread of what has been written.
_written: list[tuple[SparkSession, str, int]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share; what is written there goes with the driver."""
    if not _written:
        atexit.register(_remove_written)
    path = scratch(spark, f"quillstream-{tag}")
    _written.append((spark, path, threading.get_ident()))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    for spark, path, _ in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already
            return


def mark() -> int:
    """Where the list of written tables stands, for `release`."""
    return len(_written)


def release(since: int) -> None:
    """Remove the tables that this thread has written since a mark, but for the last; nothing may need them."""
    own = [entry for entry in _written[since:] if entry[2] == threading.get_ident()]
    for entry in own[:-1]:
        _remove(*entry[:2])
        _written.remove(entry)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner the true size, so a
    join with the table is a broadcast only where Spark's own size check allows it.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers give memory back behind each batch that they send."""

    def sparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            give_back()

    return df.mapInArrow(sparing, schema)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function from Arrow batch to Arrow batch, keeping memory to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return map_in_arrow(df, run, schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose `column` holds about `most_bytes` at most (or one row)."""
    sizes = batch.column(column).nbytes / max(1, batch.num_rows)
    step = max(1, int(most_bytes / max(1.0, sizes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def word_count(text: Column) -> Column:
    """How many words a text has; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")

"""Writes: idempotent appends, progress logs, tombstones and attribute upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import scratch


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def completed_keys(spark: SparkSession, path: str, key: str = "key", status: str = "ok") -> DataFrame:
    """Keys that a progress log has as done; broken lines are passed over."""
    log = spark.read.schema(f"{key} string, status string").option("mode", "DROPMALFORMED").json(path)
    return log.filter((F.col("status") == status) & F.col(key).isNotNull()).select(key).distinct()


def remaining(rows: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(done, key, "left_anti")


def once_per_batch(write: Callable[[DataFrame, str], None], root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function whose path holds the batch id, so a repeated batch overwrites itself."""
    return lambda batch, number: write(batch, f"{root}/batch={number}")


def add_tombstones(deleted: DataFrame, keys: DataFrame, key: str = "itemID") -> DataFrame:
    """Tombstones with those for new keys, each once."""
    return deleted.select(key).unionByName(keys.select(key).distinct().join(deleted, key, "left_anti"))


def numbered(rows: DataFrame, order: str, start: Column, number: str) -> DataFrame:
    """Rows with numbers behind `start`, in an order without ties.

    The rows are dealt out by range, written, and numbered within their range; a range starts where the ranges
    before it end, so only one row a range is ordered in a single task.
    """
    spark = rows.sparkSession
    path = scratch(spark, "numbered")
    rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.join(sizes, "_range").withColumn(number, (place + F.col("_before") + start).cast("long")).select(*rows.columns, number)


def last_number(table: DataFrame, number: str) -> Column:
    """The largest number of a table as a scalar subquery, 0 if it is empty."""
    return table.agg(F.coalesce(F.max(number), F.lit(0))).scalar()


def value_ids(values: DataFrame, dictionary: DataFrame, value: str = "value", number: str = "valueID") -> DataFrame:
    """The dictionary with numbers for new values, in order of the values, behind the largest one."""
    new = values.select(value).filter(F.col(value).isNotNull()).distinct().join(dictionary, value, "left_anti")
    return dictionary.select(number, value).unionByName(numbered(new, value, last_number(dictionary, number), number).select(number, value))


def upsert_values(current: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attribute rows where those of a patch replace their keys."""
    return current.join(patch.select(*keys), list(keys), "left_anti").select(current.columns).unionByName(patch.select(current.columns))


def move_members(members: DataFrame, moves: DataFrame, item: str = "itemID", group: str = "collectionID") -> DataFrame:
    """Memberships with each moved item's replaced by its new item's; `moves` holds item and target."""
    moved = members.join(moves, item).select(F.col(group), F.col("target").alias(item))
    return members.join(moves, item, "left_anti").select(group, item).unionByName(moved.select(group, item)).distinct()


def guarded_update(rows: DataFrame, changes: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """Rows with changes that name the version they were made from; others are left as they are."""
    c = changes.select(key, F.col(version).alias("_from"), *[F.col(x).alias(f"_new_{x}") for x in columns])
    joined = rows.join(c, key, "left")
    hit = F.col("_from").eqNullSafe(F.col(version)) & F.col("_from").isNotNull()
    out = {x: F.when(hit, F.col(f"_new_{x}")).otherwise(F.col(x)) for x in columns} | {version: F.when(hit, F.col(version) + 1).otherwise(F.col(version))}
    return joined.withColumns(out).select(rows.columns)

"""File listings and bounded reads, as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path, name, folder, length and modificationTime of the files below a folder.

    Contents are only read by queries that select `content`; the length bound reaches the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    return files.withColumns({"name": F.substring_index("path", "/", -1), "folder": F.element_at(F.split("path", "/"), -2)})


def html_files(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    return listing(spark, root, "*.{html,htm}", most_bytes)


def newest_per_folder(files: DataFrame) -> DataFrame:
    """The newest file of each folder; by name of equals."""
    order = Window.partitionBy("folder").orderBy(F.col("modificationTime").desc(), F.lower("name"))
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def texts(files: DataFrame) -> DataFrame:
    """File contents as text, with invalid bytes replaced."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))

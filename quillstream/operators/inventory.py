"""What full text an item has, which copies to keep, and which records an audit marks for clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(exists: Column) -> Column:
    """A file counts unless it is known to be missing."""
    return ~exists.eqNullSafe(F.lit(False))


def inventory(attachments: DataFrame, parent: str | Sequence[str]) -> DataFrame:
    """Counts by parent over is_pdf, is_html, is_source_html, is_generated_html and the tri-state exists."""
    here = present(F.col("exists"))
    html, source, generated = F.col("is_html"), F.col("is_source_html"), F.col("is_generated_html")
    counts = attachments.groupBy(*([parent] if isinstance(parent, str) else parent)).agg(
        F.count_if("is_pdf").alias("pdf_count"), F.count_if(html & here).alias("html_count"), F.count_if(source & here).alias("source_html_count"),
        F.count_if(generated & here).alias("generated_html_count"), F.count_if(html & ~source & ~generated & here).alias("unknown_html_count"),
        F.count_if(F.col("exists") == F.lit(False)).alias("missing_file_count"),
    )
    return counts.withColumns({"has_pdf": F.col("pdf_count") > 0, "has_html": F.col("html_count") > 0, "has_source_html": F.col("source_html_count") > 0})


def with_scan_decision(counts: DataFrame, default_limit: int = 3) -> DataFrame:
    """Whether the item is complete, how many PDFs may be fetched, and a fingerprint of the counts."""
    bit = lambda c: F.col(c).cast("int").cast("string")
    text = lambda c: F.col(c).cast("string")
    print_ = F.concat(
        F.lit("pdf="), bit("has_pdf"), F.lit(":"), text("pdf_count"), F.lit("|source_html="), bit("has_source_html"), F.lit(":"), text("source_html_count"),
        F.lit("|html="), bit("has_html"), F.lit(":"), text("html_count"),
    )
    return counts.withColumns(
        {"skip_scan": F.col("has_pdf") & F.col("has_source_html"), "pdf_limit": F.when(F.col("has_pdf"), 0).otherwise(default_limit), "fingerprint": print_}
    )


def cleanup(records: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Source copies with keep_key (largest, then newest, then largest key among those present) and reason.

    reason is missing_file, duplicate_source_html, or null for the copy that stays.
    """
    here = present(F.col("exists"))
    order = Window.partitionBy(*parent)
    rank = F.when(here, F.struct(F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime", F.lit(0)).alias("mtime"), F.col("key")))
    keyed = records.withColumn("keep_key", F.max(rank).over(order)["key"])
    reason = F.when(F.col("exists").eqNullSafe(F.lit(False)), "missing_file").when(F.col("keep_key").isNotNull() & (F.col("key") != F.col("keep_key")), "duplicate_source_html")
    return keyed.withColumn("reason", reason)


def duplicate_parents(records: DataFrame, parent: Sequence[str], key: str) -> DataFrame:
    """Parents with two records or more, with their sorted keys."""
    return records.groupBy(*parent).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("members")).filter("n >= 2")


def mark_stale(records: DataFrame, sources: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    """Append an issue to records whose keys have a source record too."""
    flagged = records.join(sources.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left")
    return flagged.withColumn("issues", F.when(F.col("_hit"), F.array_union("issues", F.array(F.lit(issue)))).otherwise(F.col("issues"))).drop("_hit")


def issue_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def split_plan(records: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """The first action whose issues a record shows; records without one are left out."""
    action = F.lit(None).cast("string")
    for name, issues in reversed(list(rules.items())):
        action = F.when(F.arrays_overlap("issues", F.array(*map(F.lit, issues))), name).otherwise(action)
    return records.withColumn("action", action).filter("action is not null")


def match_files(files: DataFrame, rows: DataFrame, path: str = "path") -> DataFrame:
    """Full outer match of listed files and table rows by path, with what was found where."""
    a, b = files.withColumn("_f", F.lit(True)), rows.withColumn("_r", F.lit(True))
    found = F.when(F.col("_f").isNull(), "row_only").when(F.col("_r").isNull(), "file_only").otherwise("both")
    return a.join(b, path, "full_outer").withColumn("found", found).drop("_f", "_r")


def unique_records(records: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The last version of each record, at the place of its first."""
    by = Window.partitionBy(*keys)
    rows = records.withColumns({"_place": F.min(ordinal).over(by), "_n": F.row_number().over(by.orderBy(F.col(ordinal).desc()))})
    return rows.filter("_n = 1").withColumn(ordinal, F.col("_place")).drop("_n", "_place")

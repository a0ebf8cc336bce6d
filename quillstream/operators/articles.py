"""Article packages: what is wrong with a polished article, its manifest, and the package's files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import blank, safe_part

LEAST_TEXT = 4000
STYLE_MARK = "data-z2m-style"
BIBLIOGRAPHY = r"(?i)(ref|bib|reference)"
FILES = {"article_html": "article.html", "assets_dir": "assets", "manifest": "manifest.json", "quality": "quality.json", "source_dir": "source", "logs_dir": "logs"}


def with_quality(rows: DataFrame, page: str = "html", title: str = "title", files: str | None = None) -> DataFrame:
    """Adds quality: title, counts, failures and warnings in their order, and the status that follows from them.

    `rows` holds the polished page, the item's title, and verdict, a struct of ok, reason and text_chars
    (null where there is none); `files` names an array of the paths beside the page, and contract a
    struct of status, failures and warnings.
    """
    text = html.visible_text(F.col(page))
    refs, anchors = html.resource_refs(F.col(page)), html.anchors(F.col(page))
    have = F.col(files) if files else F.array().cast("array<string>")
    count = lambda pattern: F.regexp_count(F.col(page), F.lit(pattern)).cast("long")
    # Each projection reads the page once for its patterns; the next one builds on it.
    out = rows.withColumns({
        "_title": F.coalesce(F.nullif(html.page_title(F.col(page)), F.lit("")), blank(F.col(title))), "_chars": F.greatest(F.length(text).cast("long"), F.coalesce("verdict.text_chars", F.lit(0)).cast("long")),
        "_refs": refs, "_images": html.attribute_values(F.col(page), "img", "src"), "_anchors": anchors, "_links": html.fragment_links(F.col(page)),
        "_payloads": count(r"(?i)<script\b") + count(rf"(?i)<style\b(?![^>]*\b{STYLE_MARK}\s*=)"), "_media": count(r"(?i)<(?:audio|video|iframe|object|embed)\b"), "_unsafe": html.unsafe_attributes(F.col(page)),
    })
    out = out.withColumns({
        "_missing": html.missing_local(F.col("_refs"), have), "_remote": F.filter("_refs", html.is_remote), "_lost_images": html.missing_local(F.col("_images"), have),
        "_lost_links": F.slice(F.array_sort(F.array_except("_links", "_anchors")), 1, 50),
    })
    failed = F.col("verdict.ok") == F.lit(False)
    failures = F.array_compact(F.array(
        F.when(F.col("_title") == "", "missing_title"), F.when(failed, F.concat(F.lit("article_verdict_"), F.coalesce(F.nullif("verdict.reason", F.lit("")), F.lit("failed")))),
        F.when((F.col("_chars") < LEAST_TEXT) & ~F.coalesce("verdict.ok", F.lit(False)), "insufficient_text"), F.when(F.size("_missing") > 0, "missing_local_resources"),
        F.when(F.size("_remote") > 0, "remote_assets_present"), F.when(F.col("_payloads") > 0, "executable_payload_present"), F.when(F.col("_media") > 0, "active_media_present"),
        F.when(F.col("_unsafe") > 0, "unsafe_attributes_present"), F.when(F.col("contract.status") == "failed", "canonical_contract_failed"),
    ))
    warnings = F.array_compact(F.array(F.when(F.size("_lost_links") > 0, "missing_internal_link_targets"), F.when(F.col("contract.status") == "warning", "canonical_contract_warning")))
    out = out.withColumns({"_failures": failures, "_warnings": warnings})
    status = F.when(F.size("_failures") > 0, "failed").when(F.size("_warnings") > 0, "warning").otherwise("passed")
    size = lambda c: F.size(c).cast("long")
    quality = F.struct(
        status.alias("status"), F.col("_title").alias("title"), F.col("_chars").alias("text_chars"), size("_images").alias("image_count"), (size("_images") - size("_lost_images")).alias("local_image_count"),
        F.slice("_lost_images", 1, 50).alias("missing_local_images"), F.slice("_missing", 1, 50).alias("missing_local_resources"), size("_remote").alias("remote_asset_count"),
        F.col("_payloads").alias("executable_payload_count"), F.col("_media").alias("active_media_count"), F.col("_unsafe").alias("unsafe_attribute_count"), size("_links").alias("internal_link_count"),
        F.col("_lost_links").alias("missing_internal_links"), size(F.filter("_anchors", lambda a: a.rlike(BIBLIOGRAPHY))).alias("bibliography_anchor_count"),
        html.math_strategy(F.col(page)).alias("math_strategy"), F.col("_failures").alias("failures"), F.col("_warnings").alias("warnings"),
    )
    return out.withColumn("quality", quality).drop(*[c for c in out.columns if c.startswith("_")])


def fingerprint(page: Column) -> dict[str, Column]:
    """bytes and sha256 of a page."""
    return {"bytes": F.octet_length(blank(page)).cast("long"), "sha256": F.sha2(blank(page).cast("binary"), 256)}


def manifest(article: Column, identifiers: Column, authors: Column, source: Column, raw: Column, quality: Column, polish: Column, created_at: Column, normalizer: str) -> Column:
    """The manifest of a package as one nested struct.

    `article` is the polished page and `raw` the page as it came; `source` a struct of provider, url,
    final_url, content_type, output_path and context.
    """
    text = lambda name: blank(source[name]).alias(name)
    prints = lambda page: F.struct(*[c.alias(n) for n, c in fingerprint(page).items()])
    return F.struct(
        F.lit(2).alias("schema_version"), F.struct(F.lit("native_html").alias("kind"), F.lit(normalizer).alias("version"), polish.alias("polish")).alias("normalizer"), created_at.cast("string").alias("created_at"),
        F.struct(quality["title"].alias("title"), authors.alias("authors"), identifiers.alias("identifiers"), F.lit("").alias("language")).alias("article"),
        F.struct(F.lit("native_html").alias("kind"), *map(text, ("context", "provider", "url", "final_url", "content_type")), blank(source["output_path"]).alias("original_output_path"), *[c.alias(n) for n, c in fingerprint(raw).items()]).alias("source"),
        F.struct(*[F.lit(v).alias(k) for k, v in FILES.items()]).alias("files"), F.struct(prints(article).alias("article_html"), prints(raw).alias("source_copy")).alias("integrity"),
        F.struct(quality["status"].alias("status"), quality["failures"].alias("failures"), quality["warnings"].alias("warnings")).alias("quality"),
    )


def package_name(source: Column, url: Column) -> Column:
    """A folder name for a package: its source, and a digest of its URL."""
    return F.concat_ws(".", safe_part(source, default="source"), F.substring(F.sha1(blank(url)), 1, 12))


def package_files(rows: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, path, content) of a package: the article, its source, manifest and quality; `rows` holds
    folder, html, raw, source_name, manifest and quality."""
    files = F.array(
        F.struct(F.lit(FILES["article_html"]).alias("path"), blank(F.col("html")).alias("content")),
        F.struct(F.concat(F.lit(FILES["source_dir"] + "/"), F.col("source_name")).alias("path"), blank(F.col("raw")).alias("content")),
        F.struct(F.lit(FILES["manifest"]).alias("path"), F.to_json("manifest").alias("content")), F.struct(F.lit(FILES["quality"]).alias("path"), F.to_json("quality").alias("content")),
    )
    return rows.select(folder, F.explode(files).alias("f")).select(folder, "f.*")


def write_packages(files: DataFrame, root: str, folder: str = "folder") -> None:
    """Write package rows as Parquet, dealt by package: Spark's commit protocol leaves no package half written."""
    files.repartition(F.col(folder)).write.mode("append").parquet(root)


def changed(rows: DataFrame, stored: DataFrame, key: str = "folder") -> DataFrame:
    """Packages whose source differs from the stored one's by size or digest, or that are not stored yet."""
    known = stored.select(key, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    same = F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("sha256").eqNullSafe(F.col("_sha256"))
    return rows.join(known, key, "left").filter(~same).drop("_bytes", "_sha256")

"""The audit of stored article pages: records with issues and warnings, and what a report says of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audit import audited
from ..functions.text import blank

# Issues that a report counts as critical, and as warnings.
CRITICAL = (
    "missing_attachment_record", "missing_web_polish_style", "missing_web_doc_main", "missing_source_kind", "unresolved_local_fragment_links", "absolute_fragment_links_resolve_local",
    "image_missing_src", "image_relative_missing_file", "image_data_non_image_mime", "image_bad_data_url", "picture_source_overrides_inline_image", "latexml_figure_render_error", "latexml_rowcolor_artifact",
    "frontiers_reference_button", "frontiers_empty_article_reference_link", "frontiers_figure_js_control", "nested_web_doc_wrapper", "pmc_dead_ui_control", "missing_def_list_style",
    "missing_latexml_caption_style", "missing_latexml_table_style", "missing_formula_style", "stale_arxiv_html_attachment", "script_tags_present", "table_without_rows", "springer_table_placeholder",
    "html_attachment_missing_file", "latexml_itemize_marker_layout", "latexml_inline_black_text", "latexml_math_black_color",
)
WARNINGS = ("figure_without_media_warning", "no_succeeded_source_html_job")
UNRECORDED, STALE, MISSING = "missing_attachment_record", "stale_arxiv_html_attachment", "html_attachment_missing_file"
#: Marks in names and titles, and languages that do not mean source pages.
SOURCE_MARK, PREPRINT_MARK = r"\[\s*source\s+html\s*\]|\bsource\s+html\b", r"\[\s*arxiv\s+html\s*\]|\barxiv\s+html\b"
GENERATED_MARK, LANGUAGE_MARK = r"\[(?:[a-z]{2,12}|mixed|unknown) html\]\.html?$", r"\[([a-z0-9]{2,12}|mixed|unknown) html\](?:\.x?html?)?"
OTHER_MARKERS = ("ru", "source", "arxiv", "ocr", "fulltext", "pdf", "html")


def flavours(name: Column, title: Column, path: Column) -> dict[str, Column]:
    """is_source_html, is_arxiv_html and is_generated_html of a page by its name, title and stored path.

    Unlike the inventory's flavours these exclude each other: what is source or preprint is not generated.
    """
    text = F.lower(F.concat_ws(" ", blank(name), blank(title), blank(path)))
    language = F.regexp_extract(text, LANGUAGE_MARK, 1)
    source = text.rlike(SOURCE_MARK) | ((language != "") & ~language.isin(*OTHER_MARKERS))
    preprint = text.rlike(PREPRINT_MARK)
    return {"is_source_html": source, "is_arxiv_html": preprint, "is_generated_html": text.rlike(GENERATED_MARK) & ~source & ~preprint}


def job_label(pipeline: Column) -> Column:
    """What a pipeline key makes of source pages: source_html, source_html_translate, or null."""
    p = blank(pipeline)
    has = lambda mark: F.contains(p, F.lit(mark))
    return (
        F.when((p == "source_html") | (has("source_html=1") & has("en=1")), "source_html")
        .when((p == "source_html_translate") | (has("source_html=1") & has("ru=1") & ~has("en=1")), "source_html_translate")
    )


def job_counts(jobs: DataFrame) -> DataFrame:
    """(label, status, n) of the jobs on source pages."""
    labelled = jobs.select(job_label(F.col("pipeline_key")).alias("label"), F.coalesce("status", F.lit("unknown")).alias("status")).filter("label is not null")
    return labelled.groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"))


def with_job(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds job_ok: whether a source job of the attachment succeeded, in its library or in any; null without any source jobs."""
    labelled = jobs.withColumn("_label", job_label(F.col("pipeline_key"))).filter("_label is not null")
    done = labelled.filter("_label = 'source_html' and status = 'succeeded' and attachment_key <> ''").select(F.col("attachment_key").alias("key")).distinct().withColumn("_done", F.lit(True))
    enabled = labelled.agg(F.count(F.lit(1)) > 0).scalar()
    return records.join(done, "key", "left").withColumn("job_ok", F.when(enabled, F.coalesce("_done", F.lit(False)))).drop("_done")


def issues(a: str = "audit") -> Column:
    """Issues of a record, in their order, over an `audited` struct and the record's flags."""
    n = lambda *names: sum((F.col(f"{a}.counts.{x}") for x in names[1:]), F.col(f"{a}.counts.{names[0]}")) > 0
    bare = lambda rule: ~F.array_contains(f"{a}.style_rules", rule)
    of_source = [
        (F.col("job_ok") == F.lit(False), "no_succeeded_source_html_job"), (~F.col(f"{a}.style_ok"), "missing_web_polish_style"), (~n("web_doc_mains"), "missing_web_doc_main"),
        (F.col(f"{a}.source_kind") == "", "missing_source_kind"), (n("local_fragment_unresolved"), "unresolved_local_fragment_links"), (n("absolute_fragment_links_resolve_local"), "absolute_fragment_links_resolve_local"),
        (n("image_missing_src"), "image_missing_src"), (n("image_relative_missing_file"), "image_relative_missing_file"), (n("image_data_non_image_mime"), "image_data_non_image_mime"),
        (n("image_bad_data_url"), "image_bad_data_url"), (n("picture_inline_data_img_with_source"), "picture_source_overrides_inline_image"), (n("latexml_figure_render_error"), "latexml_figure_render_error"),
        (n("latexml_rowcolor_artifacts"), "latexml_rowcolor_artifact"), (n("latexml_itemize_marker_blocks") & bare("latexml_itemize"), "latexml_itemize_marker_layout"),
        (n("latexml_inline_black_text_styles"), "latexml_inline_black_text"), (n("latexml_black_mathcolor_attrs"), "latexml_math_black_color"), (n("frontiers_reference_buttons"), "frontiers_reference_button"),
        (n("def_lists") & bare("def_list"), "missing_def_list_style"), (n("latexml_caption_transformed_blocks") & bare("latexml_caption"), "missing_latexml_caption_style"),
        (n("latexml_tables") & bare("latexml_table"), "missing_latexml_table_style"), (n("disp_formula_tables", "display_math_blocks") & bare("formula"), "missing_formula_style"),
        (n("scripts"), "script_tags_present"), (n("table_without_rows"), "table_without_rows"),
        ((F.col(f"{a}.source_kind") == "springer_nature_article") & n("springer_table_placeholder_markers"), "springer_table_placeholder"),
    ]
    of_both = [
        (F.col(f"{a}.counts.web_doc_mains") > 1, "nested_web_doc_wrapper"), (n("frontiers_empty_article_reference_links"), "frontiers_empty_article_reference_link"),
        (n("frontiers_figure_js_controls"), "frontiers_figure_js_control"), (n("pmc_dead_ui_controls"), "pmc_dead_ui_control"),
    ]
    source, either = F.col("is_source_html"), F.col("is_source_html") | F.col("is_generated_html")
    listed = [F.when(~F.col("recorded") & (source | F.col("is_arxiv_html")), UNRECORDED)]
    listed += [F.when(source & test, name) for test, name in of_source] + [F.when(either & test, name) for test, name in of_both]
    return F.array_compact(F.array(*listed))


def audit_records(pages: DataFrame, jobs: DataFrame, page: str = "html", files: Column | None = None, url: Column | None = None) -> DataFrame:
    """Records of stored pages with their audit, issues and warnings, stale preprint copies marked.

    `pages` holds library_id, key, parent_key, name, title, path, recorded (whether the library has the
    attachment) and the page; `jobs` holds attachment_key, status and pipeline_key.
    """
    rows = with_job(pages.withColumns(flavours(F.col("name"), F.col("title"), F.col("path"))), jobs)
    rows = rows.withColumn("audit", audited(F.col(page), files, url)).drop(page)
    warned = F.when(F.col("is_source_html") & (F.col("audit.counts.figure_without_media_warning") > 0), "figure_without_media_warning")
    rows = rows.withColumns({"issues": issues(), "warnings": F.array_compact(F.array(warned))})
    return mark_stale(rows)


def missing_records(attachments: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """Preprint attachments of the library whose file is not there, as records with that one issue."""
    rows = attachments.withColumns(flavours(F.col("name"), F.col("title"), F.col("path"))).filter("is_arxiv_html")
    return rows.join(files.select(key).distinct(), key, "left_anti").withColumns({"issues": F.array(F.lit(MISSING)), "warnings": F.array().cast("array<string>")})


def source_parents(records: DataFrame) -> DataFrame:
    """(library_id, parent_key) of the recorded source pages, each once."""
    active = records.filter(F.col("is_source_html") & (blank(F.col("parent_key")) != "") & ~F.array_contains("issues", UNRECORDED))
    return active.select("library_id", "parent_key").distinct()


def mark_stale(records: DataFrame) -> DataFrame:
    """Preprint pages whose parent has a source page get the issue of a stale copy, once."""
    hit = source_parents(records).withColumn("_source", F.lit(True))
    stale = F.col("_source") & F.col("is_arxiv_html")
    marked = records.join(hit, ["library_id", "parent_key"], "left")
    return marked.withColumn("issues", F.when(stale, F.array_union("issues", F.array(F.lit(STALE)))).otherwise(F.col("issues"))).drop("_source").select(records.columns)


def remote_stale(records: DataFrame, children: DataFrame) -> DataFrame:
    """Remote preprint pages of parents with a source page that are not known as stale: semi join, then anti join.

    `children` holds library_id, key, parent_key, title, filename, deleted of the remote items.
    """
    known = records.filter(F.array_contains("issues", STALE)).select("library_id", "key").distinct()
    preprint = F.lower(F.concat_ws(" ", "title", "filename")).rlike(PREPRINT_MARK)
    rows = children.filter((blank(F.col("key")) != "") & ~F.coalesce("deleted", F.lit(False)) & preprint)
    rows = rows.join(source_parents(records), ["library_id", "parent_key"], "left_semi").join(known, ["library_id", "key"], "left_anti")
    shown = F.coalesce(F.nullif("title", F.lit("")), F.nullif("filename", F.lit("")), "key")
    return rows.select("library_id", "key", "parent_key", shown.alias("title"), F.array(F.lit(STALE), F.lit("remote_only_arxiv_html_attachment")).alias("issues"))


def report(records: DataFrame) -> DataFrame:
    """One row: how many pages, by flavour, critical, with warnings only."""
    critical = F.arrays_overlap("issues", F.array(*map(F.lit, CRITICAL)))
    warned = (F.size("warnings") > 0) | F.arrays_overlap("issues", F.array(*map(F.lit, WARNINGS)))
    return records.agg(
        F.count(F.lit(1)).alias("html_files_total"), F.count_if("is_source_html").alias("source_html_files"), F.count_if(~F.col("is_source_html")).alias("non_source_html_files"),
        F.count_if(critical).alias("critical_records"), F.count_if(warned & ~critical).alias("warning_only_records"),
    )


def tallies(records: DataFrame) -> DataFrame:
    """(kind, name, n): issues, warnings, kinds of source pages and hosts of their remote images."""
    warned = F.concat("warnings", F.filter("issues", lambda i: i.isin(*WARNINGS)))
    hosts = F.transform("audit.remote_hosts", lambda h: F.struct(F.lit("host").alias("kind"), h["host"].alias("name"), h["n"].alias("n")))
    one = lambda kind, array: F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"), F.lit(1).cast("long").alias("n")))
    source = F.when(F.col("is_source_html"), F.concat(one("source_kind", F.array(F.coalesce(F.nullif("audit.source_kind", F.lit("")), F.lit("unknown")))), hosts))
    rows = records.select(F.explode(F.concat(one("issue", F.col("issues")), one("warning", warned), F.coalesce(source, F.array().cast("array<struct<kind:string,name:string,n:bigint>>")))).alias("t"))
    return rows.groupBy("t.kind", "t.name").agg(F.sum("t.n").alias("n"))


def duplicate_sources(records: DataFrame) -> DataFrame:
    """Parents with two source pages or more, with their keys."""
    rows = records.filter(F.col("is_source_html") & (blank(F.col("parent_key")) != ""))
    return rows.groupBy("library_id", "parent_key").agg(F.count(F.lit(1)).alias("source_count"), F.array_sort(F.collect_list("key")).alias("keys")).filter("source_count > 1")


def cleanup_totals(records: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """One row: pages that were looked at, those with any of the issues, and the parents of those."""
    hit = F.arrays_overlap("issues", F.array(*map(F.lit, wanted)))
    return records.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(hit).alias("affected"), F.countDistinct(F.when(hit, F.struct("library_id", "parent_key"))).alias("parents"))

"""Verdicts on downloaded pages, and which download of an item is the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import is_access_title
from ..functions.text import blank

# Marker sets.
STRONG = ("article_tag", "article_body", "pmc_article", "schema_article", "arxiv_ltx_document", "arxiv_ltx_abstract", "arxiv_ltx_bibliography")
SUBSTANTIVE = ("methods", "results", "discussion", "conclusion")
REFERENCE = ("references",)


def _has(found: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, names)))


def _many(found: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(found, F.array(*map(F.lit, names))))


def substantial(chars: Column, marks: Column, sections: Column) -> Column:
    """A long body, with the more evidence the shorter it is."""
    return (
        ((chars >= 30000) & (_has(marks, STRONG) | (F.size(sections) > 0))) | ((chars >= 15000) & _has(marks, STRONG))
        | ((chars >= 12000) & _has(sections, SUBSTANTIVE) & _has(sections, REFERENCE)) | ((chars >= 20000) & (_many(sections, SUBSTANTIVE) >= 2))
    )


def evident(chars: Column, marks: Column, sections: Column) -> Column:
    return _has(marks, STRONG) | ((chars >= 30000) & _has(sections, REFERENCE)) | ((chars >= 20000) & (_many(sections, SUBSTANTIVE) >= 2))


def download_reason(least: int = 8000, least_preprint: int = 4000) -> Column:
    """The verdict's reason over ok, status, output_path, url, final_url, source, kind, title, text_chars, markers, section_markers."""
    c = F.col
    chars, marks, sections = c("text_chars"), c("markers"), c("section_markers")
    pages = [c("url"), c("final_url")]
    landing = F.greatest(*[urls.is_preprint_landing(u) for u in pages])
    preprint = (F.lower(blank(c("source"))) == "arxiv") | F.greatest(*[(urls.in_domain(u, "arxiv.org") & F.lower(urls.path(u)).startswith("/html/")) | urls.in_domain(u, "ar5iv.labs.arxiv.org") for u in pages])
    doi = urls.host(F.coalesce(F.nullif(c("final_url"), F.lit("")), c("url"))).isin("doi.org", "dx.doi.org")
    return (
        F.when(~F.coalesce(c("ok"), F.lit(False)), F.coalesce(F.nullif(c("status"), F.lit("")), F.lit("download_not_ok")))
        .when(blank(c("output_path")) == "", "missing_output_path").when(landing, "arxiv_abs_landing").when(doi, "doi_landing")
        .when(chars.isNull() | (chars < 0), "article_validator_invalid_text_chars")
        .when(is_access_title(c("title")) & ~substantial(chars, marks, sections), "access_landing")
        .when(preprint, F.when((chars >= least_preprint) & _has(marks, STRONG), "arxiv_article_html").otherwise("weak_arxiv_html"))
        .when(chars < least, "short_text")
        .when(F.lower(blank(c("kind"))) == "landing", F.when(substantial(chars, marks, sections), "article_landing_with_body").otherwise("weak_landing"))
        .when(~evident(chars, marks, sections), "weak_article_evidence").otherwise("article_html")
    )


def is_accepted(reason: Column) -> Column:
    return reason.isin("article_html", "arxiv_article_html", "article_landing_with_body")


def download_score() -> Column:
    """Rank of an accepted download, as a struct that sorts ascending to the best."""
    c = F.col
    both = F.lower(F.concat_ws(" ", "url", "final_url"))
    kind = F.lower(blank(c("kind")))
    point = lambda test, n: F.when(test, n).otherwise(0)
    bonus = (
        point(kind == "html", 2) + point(F.contains(both, F.lit("/html/")), 2) + point(F.lower(blank(c("source"))) == "arxiv", 1)
        + point(_has(c("markers"), ("article_tag", "arxiv_ltx_document", "arxiv_ltx_bibliography")), 2) + point(_has(c("section_markers"), SUBSTANTIVE), 1)
    )
    refs = point(F.array_contains("markers", "references") | F.array_contains("section_markers", "references"), 1)
    return F.struct(bonus.alias("bonus"), refs.alias("refs"), c("text_chars"), (-point(kind == "landing", 1)).alias("landing"), (-F.length(blank(c("output_path")))).alias("path"))


def best_download(downloads: DataFrame, item: str, tie: str) -> DataFrame:
    """The best download of each item; the first by `tie` of equals."""
    order = Window.partitionBy(item).orderBy(F.col("score").desc(), tie)
    return downloads.withColumn("score", download_score()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

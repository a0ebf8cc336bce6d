"""Queries over web pages: features, verdicts, kinds, quality and document rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, html, urls
from ..functions.text import collapse, computed_once
from ..operators import verdicts
from ..sources.tables import load
from .registry import query

COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
#: Decodes the references that the pages hold; a page that was cut off ends in one without its semicolon.
DECODE = "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&')"
TITLE = COLLAPSE.format(DECODE.format("regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '<[^>]+>', ' ', 'g')"))
BARE = "regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs')"
TEXT = COLLAPSE.format(DECODE.format(f"regexp_replace({BARE}, '<[^>]+>', ' ', 'g')"))
MARKS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(html), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in html.ARTICLE_MARKERS) + ")"
SECTIONS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in html.SECTION_MARKERS) + ")"
FEATURES = f"WITH p AS (SELECT page_id, url, html, {TITLE} AS title, {TEXT} AS text FROM pages), f AS (SELECT page_id, url, html, title, text, length(text) AS text_chars, {MARKS} AS markers, {SECTIONS} AS sections FROM p)"
#: Pages of the test data are short; their least length is a parameter of the verdict.
LEAST = 1500
CHALLENGE = "regexp_matches(lower(title || chr(10) || text[:5000]), '" + "|".join(html.CHALLENGES) + "')"
REASON = f"""CASE WHEN {CHALLENGE} THEN 'challenge_page' WHEN contains(lower(text), '{html.PREVIEW}') THEN 'limited_access_preview' WHEN text_chars < {LEAST} THEN 'short_text'
  WHEN NOT regexp_matches(markers, '(^|,)({"|".join(html.STRONG)})(,|$)') THEN 'article_structure_missing'
  WHEN NOT (regexp_matches(markers, '(^|,)references(,|$)') OR regexp_matches(sections, '(^|,)references(,|$)') OR len(list_intersect(string_split(sections, ','), ['methods', 'results', 'discussion', 'conclusion'])) >= 2) THEN 'article_body_missing' ELSE 'article_html' END"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_features(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("html_title_and_text", FEATURES + " SELECT page_id, title, text, text_chars FROM f")
def html_title_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of each page, character references decoded."""
    return features(spark, sf_dir).select("page_id", "title", "text", "text_chars")


@query("article_markers", FEATURES + " SELECT page_id, markers, sections FROM f")
def article_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which marks of an article each page shows."""
    return features(spark, sf_dir).select("page_id", F.array_join("markers", ",").alias("markers"), F.array_join("section_markers", ",").alias("sections"))


@query("document_section_markers", f"SELECT doc_id, {SECTIONS} AS sections FROM documents")
def document_section_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section words in each document."""
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(html.markers(F.col("text"), html.SECTION_MARKERS), ",").alias("sections"))


@query("page_article_verdicts", FEATURES + f" SELECT {REASON} AS reason, count(*) AS n, CAST(sum(text_chars) AS BIGINT) AS text_chars FROM f GROUP BY 1 ORDER BY 1")
def page_article_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages get each verdict: the flagship query."""
    judged = features(spark, sf_dir).withColumn("reason", html.article_reason(F.lit(True), F.lit("generic"), F.lit(LEAST)))
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("text_chars").alias("text_chars")).orderBy("reason")


TITLED_REASON = REASON.replace("WHEN text_chars <", "WHEN page_id % 5 = 0 THEN 'title_mismatch' WHEN text_chars <", 1)


@query("page_verdict_rows", FEATURES + f" SELECT page_id, {TITLED_REASON} AS reason FROM f")
def page_verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page, with the title that is expected; a fifth of the pages are about something else."""
    expected = F.when(F.col("page_id") % 5 == 0, "quux zyzzyva frobnicate").otherwise(F.col("title"))
    rows = html.with_title_fit(features(spark, sf_dir).withColumn("expected", expected), "expected")
    return rows.select("page_id", html.article_reason(F.col("title_ok"), F.lit("generic"), F.lit(LEAST)).alias("reason"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as downloads: some failed, some without a file, some preprints and landing pages."""
    k = F.col("page_id") % 7
    url = F.when(k == 3, F.concat(F.lit("https://arxiv.org/abs/"), F.col("page_id"))).when(k == 4, F.concat(F.lit("https://arxiv.org/html/"), F.col("page_id"))).otherwise(F.col("url"))
    return features(spark, sf_dir).select(
        "page_id", urls.host(F.col("url")).alias("item"), (k != 1).alias("ok"), F.when(k == 1, "http_404").otherwise("ok").alias("status"), F.when(k == 2, "").otherwise(F.concat(F.lit("/out/"), F.col("page_id"), F.lit(".html"))).alias("output_path"),
        url.alias("url"), F.when(k == 5, "https://doi.org/10.1/x").otherwise("").alias("final_url"), F.lit("web").alias("source"), F.when(k == 6, "landing").otherwise("html").alias("kind"), "title", "text_chars", "markers", "section_markers",
    )


DOWNLOADS = FEATURES + """, d AS (SELECT page_id, split_part(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':', 1) AS item, page_id % 7 AS k, title, text_chars, markers, sections,
  CASE page_id % 7 WHEN 3 THEN 'https://arxiv.org/abs/' || page_id WHEN 4 THEN 'https://arxiv.org/html/' || page_id ELSE url END AS url, regexp_matches(markers, 'article_tag') AS strong,
  '/out/' || page_id || '.html' AS output_path FROM f)
"""
SUBSTANTIVE = "len(list_intersect(string_split(sections, ','), ['methods', 'results', 'discussion', 'conclusion']))"
DOWNLOAD_REASON = f"""CASE WHEN k = 1 THEN 'http_404' WHEN k = 2 THEN 'missing_output_path' WHEN k = 3 THEN 'arxiv_abs_landing' WHEN k = 5 THEN 'doi_landing'
  WHEN k = 4 THEN CASE WHEN text_chars >= 400 AND strong THEN 'arxiv_article_html' ELSE 'weak_arxiv_html' END WHEN text_chars < 800 THEN 'short_text'
  WHEN k = 6 THEN CASE WHEN text_chars >= 15000 AND strong THEN 'article_landing_with_body' ELSE 'weak_landing' END WHEN NOT strong THEN 'weak_article_evidence' ELSE 'article_html' END"""


@query("download_verdict_ladder", DOWNLOADS + f" SELECT page_id, {DOWNLOAD_REASON} AS reason FROM d")
def download_verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each downloaded page is usable, or the first reason why not."""
    return downloads(spark, sf_dir).select("page_id", verdicts.download_reason(800, 400).alias("reason"))


@query(
    "html_best_of_5tuple",
    DOWNLOADS
    + f""", r AS (SELECT *, {DOWNLOAD_REASON} AS reason FROM d), a AS (SELECT *, CASE WHEN k = 6 THEN 0 ELSE 2 END + CASE WHEN k = 4 THEN 2 ELSE 0 END + CASE WHEN strong THEN 2 ELSE 0 END + CASE WHEN {SUBSTANTIVE} > 0 THEN 1 ELSE 0 END AS bonus,
        CASE WHEN regexp_matches(markers, '(^|,)references(,|$)') THEN 1 ELSE 0 END AS refs FROM r WHERE reason IN ('article_html', 'arxiv_article_html', 'article_landing_with_body'))
       SELECT item, page_id FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY bonus DESC, refs DESC, text_chars DESC, CASE WHEN k = 6 THEN 1 ELSE 0 END, length(output_path), page_id) AS rn FROM a) WHERE rn = 1""",
)
def html_best_of_5tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best accepted download of each host."""
    judged = computed_once(downloads(spark, sf_dir).withColumn("reason", verdicts.download_reason(800, 400)).drop("title"))
    return verdicts.best_download(judged.filter(verdicts.is_accepted(F.col("reason"))), "item", "page_id").select("item", "page_id")


@query(
    "unsafe_and_payload_counts",
    """SELECT page_id, len(regexp_extract_all(html, '(?i)<script\\b')) AS scripts, len(regexp_extract_all(html, '(?i)<style\\b')) AS styles, len(regexp_extract_all(html, '(?i)<(?:audio|video|iframe|object|embed)\\b')) AS active_media,
       CAST(0 AS BIGINT) AS unsafe_attributes, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"[^"]*"')) AS links FROM pages""",
)
def unsafe_and_payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable payloads, active media, unsafe attributes and links of each page."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return load(spark, sf_dir, "pages").select(
        "page_id", count(r"(?i)<script\b").alias("scripts"), count(r"(?i)<style\b").alias("styles"), count(r"(?i)<(?:audio|video|iframe|object|embed)\b").alias("active_media"),
        html.unsafe_attributes(F.col("html")).alias("unsafe_attributes"), F.size(html.attribute_values(F.col("html"), "a", "href")).cast("long").alias("links"),
    )


@query(
    "page_links_exploded",
    """SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"', 1))) AS link FROM pages)""",
)
def page_links_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of each page."""
    return load(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(html.attribute_values(F.col("html"), "a", "href"))).alias("link"))


@query(
    "duplicate_anchor_targets",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"', 1)) AS link FROM pages) SELECT page_id, link, count(*) AS n FROM l GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that a page names more than once."""
    rows = load(spark, sf_dir, "pages").select("page_id", F.explode(html.attribute_values(F.col("html"), "a", "href")).alias("link"))
    return rows.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "page_manifest",
    """SELECT page_id, substr(sha1(url), 1, 10) AS digest, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '.web.' || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '[^A-Za-z0-9._-]+', '_', 'g') || '.' || substr(sha1(url), 1, 10) || '.html' AS name,
       sha256(html) AS fingerprint, strlen(html) AS bytes FROM pages""",
)
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and fingerprints of stored pages."""
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", F.substring(F.sha1("url"), 1, 10).alias("digest"), urls.source_filename(F.lit("web"), u, F.col("page_id") % 100).alias("name"), F.sha2(F.col("html").cast("binary"), 256).alias("fingerprint"), F.octet_length("html").cast("long").alias("bytes"))


@query("strip_payloads", "SELECT page_id, strlen(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\\b[^>]*>.*?</script\\s*>', '', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', '', 'gis')) AS bytes FROM pages")
def strip_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each page without comments, scripts and styles."""
    return load(spark, sf_dir, "pages").select("page_id", F.octet_length(html.without_payloads(F.col("html"))).cast("long").alias("bytes"))


@query("polish_pages")
def polish_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page reduced to its article in a plain shell."""
    return load(spark, sf_dir, "pages").select("page_id", documents.polish_page("html", "url").alias("p")).select("page_id", "p.*")


@query("sanitize_pages")
def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without active elements and unlisted attributes."""
    return load(spark, sf_dir, "pages").select("page_id", documents.sanitize_page("html").alias("html"))


@query("extract_article", FEATURES + " SELECT page_id, 'article' AS selector FROM f")
def extract_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which element of each page is its article."""
    return polish_pages(spark, sf_dir).select("page_id", "selector")


@query("audit_page_metrics", "SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b')) AS links, len(regexp_extract_all(html, '(?i)<script\\b')) AS scripts, len(regexp_extract_all(html, '(?i)<style\\b')) AS styles, 'script_tags_present' AS first_issue FROM pages")
def audit_page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and issues of each page from one parse."""
    return documents.audit(load(spark, sf_dir, "pages")).select("page_id", "m.links", "m.scripts", "m.styles", F.get("issues", F.lit(0)).alias("first_issue"))


@query("page_collapse_whitespace", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def page_collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space runs as one space."""
    return load(spark, sf_dir, "documents").select("doc_id", collapse(F.col("text")).alias("text"))

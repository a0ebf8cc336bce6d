"""Audit, article package and location queries over pages to which marks of stored articles are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, kinds, repairs, urls
from ..functions import audit as page_audit
from ..operators import articles, audit
from ..operators import candidates as cand
from ..sources.tables import load
from .page_queries import DECODE, TITLE
from .registry import query
from .state_queries import pick

EXTRAS = (
    "<figure><p>none</p></figure><table></table>", '<figure><img src="pic.png" alt="x"></figure><img>', '<picture><source srcset="a.png 1x"><img src="data:image/png;base64,AAAA"></picture><img src="data:text/plain,x">',
    '<a href="#nowhere">n</a><a id="here" href="#here">h</a>', '<table><tr><td>1</td><th>2</th></tr></table><dl class="def-list"></dl>',
    '<button class="ArticleReference">1</button><a class="ArticleReference" data-event="articleReference-a-1">x</a><button aria-label="Show article permalink">p</button>',
    '<figure class="ltx_table"></figure><math display="block"></math><main id="web-doc"></main>', '<img src="https://h.example/x.png" alt=" "><figure><a href="t.csv">t</a></figure>',
)
NAMES = ("a [source html].html", "b [arXiv HTML].html", "c [ru html].html", "plain.html")
PIPELINES = ("source_html", "v=1|source_html=1|en=1", "source_html=1|ru=1", "ocr", "source_html_translate")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored articles: a shell, one of several extras, a name, a parent, and whether the library knows them."""
    k = F.col("page_id")
    page = F.concat(F.lit('<main id="web-doc" data-z2m-source-kind="'), F.when(k % 5 != 0, "pmc_article").otherwise(""), F.lit('">'), F.coalesce("html", F.lit("")), pick(EXTRAS, k % 8), F.lit("</main>"))
    return load(spark, sf_dir, "pages").select(
        F.lit("lib").alias("library_id"), k.cast("string").alias("key"), F.concat(F.lit("P"), (k % 20).cast("string")).alias("parent_key"), pick(NAMES, k % 4).alias("name"), F.lit("t").alias("title"), F.concat(F.lit("storage:"), pick(NAMES, k % 4)).alias("path"),
        (k % 9 != 0).alias("recorded"), page.alias("html"), "url", "page_id",
    )


def page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select((k % 400).cast("string").alias("attachment_key"), F.when(k % 3 == 0, "succeeded").when(k % 3 == 1, "failed_final").alias("status"), pick(PIPELINES, k % 5).alias("pipeline_key"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_records(stored_pages(spark, sf_dir), page_jobs(spark, sf_dir), files=F.array(F.lit("a.png")))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(page, '{pattern}'))"


PAGES = f"""WITH s AS (SELECT page_id, url, CAST(page_id AS VARCHAR) AS key, 'P' || page_id % 20 AS parent_key, {_list(NAMES)}[page_id % 4 + 1] AS name, page_id % 9 <> 0 AS recorded,
  '<main id="web-doc" data-z2m-source-kind="' || CASE WHEN page_id % 5 <> 0 THEN 'pmc_article' ELSE '' END || '">' || coalesce(html, '') || {_list(EXTRAS)}[page_id % 8 + 1] || '</main>' AS page FROM pages),
c AS (SELECT *, name LIKE '%[source%' AS source, name LIKE '%[arXiv%' AS preprint, name LIKE '%[ru%' AS generated,
  {_count('(?i)<a[ >][^>]*href="[^"]+"')} + {_count('(?i)<a href="[^"]+"')} * 0 AS links, {_count('(?i)<img[ >]')} AS images, {_count('(?i)<img[ >]')} - {_count('(?i)<img[^>]* alt="[^" ]+')} AS image_empty_alt,
  {_count('(?i)<img>')} AS image_missing_src, {_count('(?i)<img src="https?:')} AS image_remote_src, {_count('(?i)<img src="pic')} AS image_relative_src, {_count('(?i)<figure[ >]')} AS figures, {_count('(?i)<script[ >]')} AS scripts,
  {_count('(?i)<table[ >]')} AS tables, {_count('(?i)<tr[ >]')} AS table_rows, {_count('(?i)<t[dh]>')} AS table_cells, {_count('(?i)<table></table>')} AS table_without_rows, {_count('(?i)<main id="web-doc"')} AS web_doc_mains,
  {_count('(?i)<dl class="def-list"')} AS def_lists, {_count('(?i)<math display="block"')} AS display_math_blocks, {_count('<figure class="ltx_table"')} AS latexml_tables, {_count('<figure><p>')} AS bare_figures,
  {_count('href="#nowhere"')} AS unresolved, {_count('data:text/plain')} AS other_data, {_count('<picture><source')} AS pictures, {_count('<button class="ArticleReference"')} AS reference_buttons,
  {_count('data-event="articleReference-a-')} AS empty_references, {_count('permalink')} AS dead_controls FROM s),
j AS (SELECT DISTINCT CAST(o_orderkey % 400 AS VARCHAR) AS key FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 < 2),
i AS (SELECT c.*, list_filter([CASE WHEN NOT recorded AND (source OR preprint) THEN 'missing_attachment_record' END, CASE WHEN source AND j.key IS NULL THEN 'no_succeeded_source_html_job' END, CASE WHEN source THEN 'missing_web_polish_style' END,
  CASE WHEN source AND page LIKE '%source-kind=""%' THEN 'missing_source_kind' END, CASE WHEN source AND unresolved > 0 THEN 'unresolved_local_fragment_links' END, CASE WHEN source AND image_missing_src > 0 THEN 'image_missing_src' END,
  CASE WHEN source AND image_relative_src > 0 THEN 'image_relative_missing_file' END, CASE WHEN source AND other_data > 0 THEN 'image_data_non_image_mime' END, CASE WHEN source AND pictures > 0 THEN 'picture_source_overrides_inline_image' END,
  CASE WHEN source AND reference_buttons > 0 THEN 'frontiers_reference_button' END, CASE WHEN source AND def_lists > 0 THEN 'missing_def_list_style' END, CASE WHEN source AND latexml_tables > 0 THEN 'missing_latexml_table_style' END,
  CASE WHEN source AND display_math_blocks > 0 THEN 'missing_formula_style' END, CASE WHEN source AND scripts > 0 THEN 'script_tags_present' END, CASE WHEN source AND table_without_rows > 0 THEN 'table_without_rows' END,
  CASE WHEN (source OR generated) AND web_doc_mains > 1 THEN 'nested_web_doc_wrapper' END, CASE WHEN (source OR generated) AND empty_references > 0 THEN 'frontiers_empty_article_reference_link' END,
  CASE WHEN (source OR generated) AND dead_controls > 0 THEN 'pmc_dead_ui_control' END], lambda x: x IS NOT NULL) AS own, source AND bare_figures > 0 AS bare FROM c LEFT JOIN j USING (key)),
p AS (SELECT DISTINCT parent_key FROM i WHERE source AND recorded),
r AS (SELECT i.*, CASE WHEN preprint AND p.parent_key IS NOT NULL THEN own || ['stale_arxiv_html_attachment'] ELSE own END AS issues FROM i LEFT JOIN p USING (parent_key))
"""
SHOWN = ("links", "images", "image_empty_alt", "image_missing_src", "image_remote_src", "image_relative_src", "figures", "scripts", "tables", "table_rows", "table_cells", "table_without_rows", "web_doc_mains", "def_lists", "display_math_blocks", "latexml_tables")


@query("page_audit_counts", PAGES + f"SELECT page_id, {', '.join(SHOWN)} FROM c")
def page_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that the audit takes from each page."""
    rows = stored_pages(spark, sf_dir).select("page_id", page_audit.audited(F.col("html")).alias("a"))
    return rows.select("page_id", *[f"a.counts.{c}" for c in SHOWN])


@query("page_audit_issues", PAGES + "SELECT page_id, array_to_string(issues, ',') AS issues, CASE WHEN bare THEN 'figure_without_media_warning' ELSE '' END AS warnings FROM r")
def page_audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and warnings of each page, stale preprint copies marked."""
    return records(spark, sf_dir).select("page_id", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"))


WARNED = "bare OR list_contains(issues, 'no_succeeded_source_html_job')"
IS_CRITICAL = f"len(list_intersect(issues, {_list(audit.CRITICAL)})) > 0"


@query("audit_report", PAGES + f"SELECT count(*) AS html_files_total, count(*) FILTER (source) AS source_html_files, count(*) FILTER (NOT source) AS non_source_html_files, count(*) FILTER ({IS_CRITICAL}) AS critical_records, count(*) FILTER (({WARNED}) AND NOT ({IS_CRITICAL})) AS warning_only_records FROM r")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit's report says in numbers."""
    return audit.report(records(spark, sf_dir))


@query(
    "audit_tallies",
    PAGES
    + """, t AS (SELECT 'issue' AS kind, unnest(issues) AS name FROM r UNION ALL SELECT 'warning', 'figure_without_media_warning' FROM r WHERE bare UNION ALL SELECT 'warning', 'no_succeeded_source_html_job' FROM r WHERE list_contains(issues, 'no_succeeded_source_html_job')
         UNION ALL SELECT 'source_kind', CASE WHEN page LIKE '%source-kind=""%' THEN 'unknown' ELSE 'pmc_article' END FROM r WHERE source AND web_doc_mains = 1 UNION ALL SELECT 'source_kind', 'unknown' FROM r WHERE source AND web_doc_mains > 1
         UNION ALL SELECT 'host', 'h.example' FROM r WHERE source AND image_remote_src > 0)
       SELECT kind, name, count(*) AS n FROM t GROUP BY 1, 2""",
)
def audit_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the audit found each issue, warning, kind of source and host of images."""
    return audit.tallies(records(spark, sf_dir))


@query("duplicate_source_pages", PAGES + "SELECT parent_key, count(*) AS source_count, string_agg(key, ',' ORDER BY key) AS keys FROM r WHERE source GROUP BY 1 HAVING count(*) > 1")
def duplicate_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with several source pages."""
    return audit.duplicate_sources(records(spark, sf_dir)).select("parent_key", "source_count", F.array_join("keys", ",").alias("keys"))


@query("audit_cleanup_totals", PAGES + "SELECT count(*) AS scanned, count(*) FILTER (hit) AS affected, count(DISTINCT parent_key) FILTER (hit) AS parents FROM (SELECT *, list_contains(issues, 'script_tags_present') OR list_contains(issues, 'stale_arxiv_html_attachment') AS hit FROM r)")
def audit_cleanup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a clean-up looks at, touches, and their parents."""
    return audit.cleanup_totals(records(spark, sf_dir), ["script_tags_present", "stale_arxiv_html_attachment"])


@query("audit_job_counts", f"SELECT label, coalesce(CASE o_orderkey % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed_final' END, 'unknown') AS status, count(*) AS n FROM (SELECT o_orderkey, ['source_html', 'source_html', 'source_html_translate', NULL, 'source_html_translate'][o_orderkey % 5 + 1] AS label FROM orders) WHERE label IS NOT NULL GROUP BY 1, 2")
def audit_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs on source pages by what they make and how they stand."""
    return audit.job_counts(page_jobs(spark, sf_dir))


@query(
    "remote_stale_pages",
    PAGES
    + """, ch AS (SELECT CAST(c_custkey AS VARCHAR) AS key, 'P' || c_custkey % 25 AS parent_key, CASE WHEN c_custkey % 2 = 0 THEN 'x [arXiv HTML]' ELSE '' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'arxiv html.html' ELSE 'y.pdf' END AS filename, c_custkey % 7 = 0 AS deleted FROM customer)
       SELECT key, parent_key, CASE WHEN title <> '' THEN title ELSE filename END AS title FROM ch WHERE NOT deleted AND (title <> '' OR filename LIKE 'arxiv%') AND parent_key IN (SELECT parent_key FROM r WHERE source AND recorded)
       AND key NOT IN (SELECT key FROM r WHERE list_contains(issues, 'stale_arxiv_html_attachment'))""",
)
def remote_stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote preprint pages that a source page makes stale and the audit does not know of."""
    k = F.col("c_custkey")
    children = load(spark, sf_dir, "customer").select(
        F.lit("lib").alias("library_id"), k.cast("string").alias("key"), F.concat(F.lit("P"), (k % 25).cast("string")).alias("parent_key"), F.when(k % 2 == 0, "x [arXiv HTML]").otherwise("").alias("title"),
        F.when(k % 3 == 0, "arxiv html.html").otherwise("y.pdf").alias("filename"), (k % 7 == 0).alias("deleted"),
    )
    return audit.remote_stale(records(spark, sf_dir), children).select("key", "parent_key", "title")


@query("missing_preprint_files", f"SELECT CAST(page_id AS VARCHAR) AS key FROM pages WHERE {_list(NAMES)}[page_id % 4 + 1] LIKE '%[arXiv%' AND page_id % 3 <> 0")
def missing_preprint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprint attachments whose file is not there."""
    rows = stored_pages(spark, sf_dir).withColumn("file_path", F.concat(F.lit("/s/"), "key"))
    return audit.missing_records(rows, rows.filter("page_id % 3 = 0")).select("key")


# --- article packages ------------------------------------------------------------------------------


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with a verdict and a contract, and the files beside them."""
    k = F.col("page_id")
    verdict = F.when(k % 3 != 0, F.struct((k % 3 == 1).alias("ok"), F.when(k % 2 == 0, "short_text").alias("reason"), (k % 5000).alias("text_chars")))
    contract = F.struct(pick(("passed", "warning", "failed"), k % 3).alias("status"))
    return articles.with_quality(stored_pages(spark, sf_dir).withColumns({"verdict": verdict, "contract": contract, "files": F.when(k % 2 == 0, F.array(F.lit("pic.png"), F.lit("a.png"))).otherwise(F.array().cast("array<string>")), "title": F.lit("")}), files="files")


BARE = "regexp_replace(regexp_replace(regexp_replace(page, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs')"
CHARS = "length(trim(regexp_replace(" + DECODE.format(f"regexp_replace({BARE}, '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g')))"
TITLED = TITLE.replace("html,", "page,")
QUALITY = PAGES + f""", q AS (SELECT *, page_id % 3 <> 0 AS has_verdict, greatest({CHARS}, CASE WHEN page_id % 3 <> 0 THEN page_id % 5000 ELSE 0 END) AS chars, {TITLED} AS t FROM c),
f AS (SELECT *, list_filter([CASE WHEN t = '' THEN 'missing_title' END, CASE WHEN page_id % 3 = 2 THEN 'article_verdict_' || CASE WHEN page_id % 2 = 0 THEN 'short_text' ELSE 'failed' END END,
  CASE WHEN chars < 4000 AND page_id % 3 <> 1 THEN 'insufficient_text' END, CASE WHEN page_id % 2 = 1 AND (image_relative_src > 0 OR pictures > 0) THEN 'missing_local_resources' END, CASE WHEN image_remote_src > 0 THEN 'remote_assets_present' END,
  CASE WHEN {_count('(?i)<(script|style)[ >]')} > 0 THEN 'executable_payload_present' END, CASE WHEN page_id % 3 = 2 THEN 'canonical_contract_failed' END], lambda x: x IS NOT NULL) AS failures,
  list_filter([CASE WHEN unresolved > 0 THEN 'missing_internal_link_targets' END, CASE WHEN page_id % 3 = 1 THEN 'canonical_contract_warning' END], lambda x: x IS NOT NULL) AS warnings FROM q)
"""


@query("article_quality", QUALITY + "SELECT page_id, CASE WHEN len(failures) > 0 THEN 'failed' WHEN len(warnings) > 0 THEN 'warning' ELSE 'passed' END AS status, array_to_string(failures, ',') AS failures, array_to_string(warnings, ',') AS warnings, CAST(chars AS BIGINT) AS text_chars, images - image_missing_src AS image_count, image_remote_src AS remote_asset_count FROM f")
def article_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation ladder of polished articles."""
    q = lambda c: F.col(f"quality.{c}")
    return judged(spark, sf_dir).select("page_id", q("status"), F.array_join(q("failures"), ",").alias("failures"), F.array_join(q("warnings"), ",").alias("warnings"), q("text_chars"), q("image_count"), q("remote_asset_count"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).join(load(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw")), "page_id")
    source = F.struct(F.lit("web").alias("provider"), F.col("url").alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit("text/html").alias("content_type"), F.concat(F.lit("/out/"), F.col("page_id")).alias("output_path"), F.lit("job").alias("context"))
    made = articles.manifest(F.col("html"), F.create_map(F.lit("DOI"), F.concat(F.lit("10.1/"), F.col("page_id"))), F.array(F.lit("A")), source, F.col("raw"), F.col("quality"), F.struct(F.lit("pmc").alias("kind")), F.lit("2024-01-01"), "1")
    return rows.withColumns({"manifest": made, "folder": articles.package_name(F.lit("web"), F.col("url")), "source_name": F.concat(F.col("page_id"), F.lit(".html"))})


@query(
    "article_manifests",
    QUALITY
    + """SELECT f.page_id, '2' AS version, f.t AS title, f.url, '10.1/' || f.page_id AS doi, sha256(p.html) AS source_sha256, strlen(f.page) AS article_bytes, CASE WHEN len(failures) > 0 THEN 'failed' WHEN len(warnings) > 0 THEN 'warning' ELSE 'passed' END AS status,
         'web.' || substr(sha1(f.url), 1, 12) AS folder FROM f JOIN pages p USING (page_id)""",
)
def article_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the nested manifests of all packages."""
    v = F.parse_json(F.to_json("manifest"))
    at = lambda path, kind="string": F.variant_get(v, path, kind)
    return packages(spark, sf_dir).select(
        "page_id", at("$.schema_version").alias("version"), at("$.article.title").alias("title"), at("$.source.url").alias("url"), at("$.article.identifiers.DOI").alias("doi"), at("$.source.sha256").alias("source_sha256"),
        at("$.integrity.article_html.bytes", "long").alias("article_bytes"), at("$.quality.status").alias("status"), "folder",
    )


@query("article_package_files", PAGES + """SELECT 'web.' || substr(sha1(url), 1, 12) AS folder, 'article.html' AS path, strlen(page) AS bytes FROM s UNION ALL SELECT 'web.' || substr(sha1(url), 1, 12), 'source/' || page_id || '.html', strlen(html) FROM pages""")
def article_package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages among the files of all packages, with their sizes."""
    files = articles.package_files(packages(spark, sf_dir))
    return files.filter(~F.col("path").endswith(".json")).select("folder", "path", F.octet_length("content").cast("long").alias("bytes"))


@query("changed_packages", "SELECT page_id FROM pages WHERE page_id % 4 < 2")
def changed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages whose source is new or not the stored one."""
    prints = articles.fingerprint(F.col("html"))
    rows = load(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in prints.items()])
    stored = rows.filter("page_id % 4 > 0").withColumn("sha256", F.when(F.col("page_id") % 4 == 1, "other").otherwise(F.col("sha256")))
    return articles.changed(rows, stored, "page_id").select("page_id")


# --- locations -------------------------------------------------------------------------------------


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched locations of several publishers, with citation fields and links."""
    k = F.col("page_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    final = (
        F.when(k % 6 == 0, text("https://iopscience.iop.org/article/10.1/", k, "/?x=1")).when(k % 6 == 1, text("https://www.thieme-connect.de/products/ejournals/abstract/10.1/", k, "?q=1"))
        .when(k % 6 == 2, text("https://www.thieme-connect.de/products/x/", k)).when(k % 6 == 3, text("https://link.springer.com/chapter/", k)).when(k % 6 == 4, text("https://link.springer.com/article/", k)).otherwise(text("https://j.example.org/a/", k))
    )
    head = F.when(k % 2 == 0, text('<META content="/pdf/', k, '.pdf" name="citation_pdf_url"><meta property="citation_pdf_url" content="b.pdf">')).otherwise('<meta name="citation_pdf_url" content="https://x.org/supplement1.pdf"><meta name="citation_pdf_url_x" content="no">')
    link = F.when(k % 6 == 2, '<a href="/products/ejournals/html/10.1/z">full</a>').otherwise("")
    title = F.when(k % 5 == 0, "<title>Get access &amp; more</title>").otherwise("<title>A study</title>")
    return load(spark, sf_dir, "pages").select("page_id", pick(("landing", "html", "doi", "pdf"), k % 4).alias("kind"), final.alias("final_url"), F.concat(F.lit("<html>"), title, head, link, F.coalesce("html", F.lit(""))).alias("html"))


FETCHED = """WITH p AS (SELECT page_id, ['landing', 'html', 'doi', 'pdf'][page_id % 4 + 1] AS kind, page_id % 5 = 0 AS access, CASE page_id % 6 WHEN 0 THEN 'https://iopscience.iop.org/article/10.1/' || page_id || '/?x=1' WHEN 1 THEN 'https://www.thieme-connect.de/products/ejournals/abstract/10.1/' || page_id || '?q=1'
  WHEN 2 THEN 'https://www.thieme-connect.de/products/x/' || page_id WHEN 3 THEN 'https://link.springer.com/chapter/' || page_id WHEN 4 THEN 'https://link.springer.com/article/' || page_id ELSE 'https://j.example.org/a/' || page_id END AS final_url FROM pages),
u AS (SELECT *, regexp_extract(final_url, '^(https://[^/]*)', 1) AS root, regexp_replace(regexp_extract(final_url, '^([^?]*)', 1), '[^/]*$', '') AS folder FROM p)
"""


@query(
    "derived_pdf_locations",
    FETCHED
    + """SELECT page_id, root || '/pdf/' || page_id || '.pdf' AS url, 'citation_pdf_url' AS derivation FROM u WHERE page_id % 2 = 0 UNION ALL SELECT page_id, folder || 'b.pdf', 'citation_pdf_url' FROM u WHERE page_id % 2 = 0
         UNION ALL SELECT page_id, 'https://iopscience.iop.org/article/10.1/' || page_id || '/pdf', 'iop_article_pdf' FROM u WHERE page_id % 6 = 0""",
)
def derived_pdf_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs that fetched pages let derive, from their fields and their URLs."""
    return fetched(spark, sf_dir).select("page_id", F.explode(html.derived_pdfs(F.col("html"), F.col("final_url"))).alias("d")).select("page_id", "d.url", "d.derivation")


@query("canonical_article_urls", FETCHED + "SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'https://www.thieme-connect.de/products/ejournals/html/10.1/' || page_id WHEN 2 THEN 'https://www.thieme-connect.de/products/ejournals/html/10.1/z' ELSE '' END AS canonical FROM u")
def canonical_article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full article behind abstract pages."""
    return fetched(spark, sf_dir).select("page_id", html.canonical_article_url(F.col("html"), F.col("final_url")).alias("canonical"))


@query(
    "landing_rejections",
    FETCHED
    + """, r AS (SELECT *, CASE WHEN kind IN ('landing', 'doi') AND page_id % 6 IN (0, 4) THEN 'html' ELSE kind END AS resolved FROM u)
       SELECT page_id, resolved, CASE WHEN resolved = 'html' THEN CASE WHEN access THEN 'access_landing' ELSE '' END WHEN kind = 'pdf' THEN '' WHEN access THEN 'access_landing' WHEN page_id % 6 IN (1, 3) THEN 'publisher_landing' WHEN page_id % 7 = 0 THEN 'weak_landing' ELSE '' END AS rejection FROM r""",
)
def landing_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a location turns out to be, and why a landing page is not taken."""
    rows = fetched(spark, sf_dir).withColumn("resolved", html.resolved_kind(F.col("kind"), F.col("final_url")))
    return rows.select("page_id", "resolved", html.landing_rejection(F.col("kind"), F.col("resolved"), F.col("final_url"), html.page_title(F.col("html")), F.col("page_id") % 7 == 0).alias("rejection"))


@query(
    "full_text_pdf_locations",
    """WITH d AS (SELECT s_suppkey, s_nationkey, 0 AS f, s_suppkey AS o, 'PDF' AS kind, 'https://x/' || s_suppkey % 4 AS url FROM supplier UNION ALL SELECT s_suppkey, s_nationkey, 1, s_suppkey, 'pdf', 'https://x/' || s_suppkey % 6 FROM supplier WHERE s_suppkey % 5 <> 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, url ORDER BY f, o) AS n FROM d) SELECT s_nationkey, url, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY f, o, url) AS INTEGER) AS ordinal FROM r WHERE n = 1""",
)
def full_text_pdf_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered PDFs, and derived ones behind them, each once."""
    s = load(spark, sf_dir, "supplier")
    of = lambda df, kind, n: df.select("s_nationkey", F.col("s_suppkey").alias("ordinal"), F.lit("w").alias("source"), F.concat(F.lit(" https://x/"), F.col("s_suppkey") % n).alias("url"), F.lit(kind).alias("kind"))
    rows = cand.pdf_locations(of(s, "PDF", 4), of(s, "pdf", 6).unionByName(of(s, "pdf", 6).withColumn("url", F.lit(" "))).join(s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("ordinal")), "ordinal", "left_anti"), "s_nationkey")
    return rows.select("s_nationkey", F.trim("url").alias("url"), "ordinal")


@query(
    "browser_fallback_locations",
    """WITH l AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.researchgate.net/p/' || s_suppkey % 3 ELSE 'https://x/1' END AS url, CASE WHEN s_suppkey % 4 = 0 THEN 'pdf' ELSE 'landing' END AS kind FROM supplier)
       SELECT s_nationkey, url, kind FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, url ORDER BY s_suppkey) AS n FROM l WHERE url LIKE '%researchgate%') WHERE n = 1 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
)
def browser_fallback_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of a sharing site for items that have no PDF."""
    k = F.col("s_suppkey")
    rows = load(spark, sf_dir, "supplier").select("s_nationkey", k.alias("ordinal"), F.when(k % 2 == 0, F.concat(F.lit("https://www.researchgate.net/p/"), k % 3)).otherwise("https://x/1").alias("url"), F.when(k % 4 == 0, "pdf").otherwise(" ").alias("kind"))
    complete = load(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return cand.browser_fallbacks(rows, complete, "s_nationkey", "researchgate.net").select("s_nationkey", "url", "kind")


@query("landing_preprint_ids", "SELECT DISTINCT p_size, '2101.' || (10000 + p_partkey % 50) AS preprint_id FROM part WHERE p_partkey % 3 <> 2")
def landing_preprint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints whose abstract pages the downloads of an item hit."""
    k = F.col("p_partkey")
    page = F.concat(F.lit("https://arxiv.org/abs/2101."), 10000 + k % 50, F.lit("v"), k % 3 + 1)
    rows = load(spark, sf_dir, "part").select("p_size", k.alias("ordinal"), F.when(k % 3 == 0, page).otherwise("https://x/y").alias("url"), F.when(k % 3 == 1, page).alias("final_url"))
    return cand.landing_preprints(rows, "p_size")


@query("asset_filenames", """SELECT page_id, lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || '.' || substr(sha1(u), 1, 12) || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.woff2' ELSE '.bin' END AS name, page_id % 3 = 0 AS pdf
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://x/Download/a.PNG?v=' || page_id WHEN 1 THEN 'https://x/b?f=' || page_id ELSE 'https://x/c.averylongsuffix/' || page_id END AS u FROM pages)""")
def asset_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of assets, and which URLs look like downloads."""
    k = F.col("page_id")
    u = F.when(k % 3 == 0, F.concat(F.lit("https://x/Download/a.PNG?v="), k)).when(k % 3 == 1, F.concat(F.lit("https://x/b?f="), k)).otherwise(F.concat(F.lit("https://x/c.averylongsuffix/"), k))
    rows = load(spark, sf_dir, "pages").select("page_id", u.alias("u"))
    return rows.select("page_id", urls.asset_filename(k % 1000, F.col("u"), F.when(k % 3 == 1, "Font/woff2; x=1").otherwise("")).alias("name"), urls.looks_like_pdf_download(F.col("u")).alias("pdf"))


@query("preprint_page_validity", PAGES + f""", v AS (SELECT page_id, page LIKE '%<html%' AND position('<html' IN lower(page)) <= 1996 AS tagged, length(trim(regexp_replace({DECODE.format("regexp_replace(page, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'))) AS n FROM s)
    SELECT page_id, CASE WHEN NOT tagged THEN 'missing_html_tag' WHEN n < 1500 THEN 'too_little_text' ELSE 'ok' END AS reason, CAST(CASE WHEN tagged THEN n ELSE 0 END AS BIGINT) AS text_chars FROM v""")
def preprint_page_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether fetched preprint pages hold enough text."""
    return stored_pages(spark, sf_dir).select("page_id", html.valid_preprint_html(F.col("html"), 1500).alias("v")).select("page_id", "v.reason", "v.text_chars")


MARKS = ("", "ltx_page_main ltx_bibliography", "hlfld-fulltext", "c-article-body", "www.researchgate.net", "content.sciendo.com article-content full article", "pkp id=\"articlefulltext\" id=\"articleabstract\" citation_pdf_url", "<article")


@query(
    "web_kind_classifier",
    f"""WITH m AS (SELECT page_id, lower(coalesce(html, '') || repeat(' ', CASE WHEN page_id % 3 = 0 THEN 600000 ELSE 0 END) || {_list(MARKS)}[page_id % 8 + 1]) AS low FROM pages)
        SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'arxiv_abs_page' WHEN contains(low, 'content.sciendo.com') AND contains(low, 'article-content') THEN 'generic_article' WHEN contains(low, 'pkp id="articlefulltext"') THEN 'ojs_abstract_page'
          WHEN contains(low, 'ltx_page_main') THEN 'arxiv_latexml' WHEN contains(low, 'hlfld-fulltext') THEN 'taylor_francis_article' WHEN contains(low, 'c-article-body') THEN 'springer_nature_article' WHEN contains(low, 'www.researchgate.net') THEN 'researchgate_page'
          WHEN contains(low[:500000], '<article') THEN 'generic_article' ELSE 'unknown' END AS kind FROM m""",
)
def web_kind_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each page, marks far below the head included."""
    k = F.col("page_id")
    url = F.when(k % 11 == 0, F.concat(F.lit("https://arxiv.org/abs/2101.0"), 1000 + k % 9000)).otherwise("https://x.example.org/")
    page = F.concat(F.coalesce("html", F.lit("")), F.repeat(F.lit(" "), F.when(k % 3 == 0, 600_000).otherwise(0)), pick(MARKS, k % 8))
    return load(spark, sf_dir, "pages").select("page_id", kinds.page_kind(page, url).alias("kind"))


def _title_page(k: Column) -> Column:
    return F.when(k % 3 == 0, html.page_title(F.col("html"))).when(k % 3 == 1, "quux zyzzyva frobnicate").otherwise("")


@query("title_gate", "SELECT page_id, page_id % 3 <> 1 AS fits FROM pages")
def title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page is about the expected title: its own, a foreign one, or none."""
    rows = html.with_features(load(spark, sf_dir, "pages").select("page_id", "html"))
    return html.with_title_fit(rows.withColumn("expected", _title_page(F.col("page_id"))), "expected", "fits").select("page_id", "fits")


# --- repairs ---------------------------------------------------------------------------------------

BROKEN = (
    '<p class="a">x<ul><li>1</li></ul> y</p>', '<p id="i"><img src="a.png"><br></p>', '<button class="ArticleReference" id="B1-button">1</button><i id="b1"></i>', '<a class="ArticleReference" data-event="articleReference-a-B9">2</a>',
    '<table><tr class="ltx_equation"><td class="ltx_eqn_eqno">1</td><td>E</td></tr></table>', "<p>plain</p>",
)
MENDED = (
    '<p class="a">x</p><ul><li>1</li></ul><p class="a"> y</p>', '<figure id="i" class="standalone-media"><img src="a.png"><br></figure>', '<a class="ArticleReference citation" href="#b1" id="B1-button">1</a><i id="b1"></i>', '<span class="ArticleReference unresolved-reference" data-unresolved-reference="B9">2</span>',
    '<table><tr class="ltx_equation"><td class="ltx_eqn_eqno">1</td><td class="single-equation-cell">E</td></tr></table>', "<p>plain</p>",
)


@query("page_repairs", f"SELECT page_id, {_list(MENDED)}[page_id % 6 + 1] || '<h1>' || page_id || '</h1>' AS html FROM pages")
def page_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference links, block flow, image paragraphs and equations of pages, mended in one parse."""
    k = F.col("page_id")
    return load(spark, sf_dir, "pages").select("page_id", repairs.repaired(F.concat(pick(BROKEN, k % 6), F.lit("<h1>"), k, F.lit("</h1>"))).alias("html"))


@query(
    "inlined_assets",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<img src="data:image/gif;base64,R0lGODlh" data-source="a.gif">' ELSE '<img src="a.gif">' END || '<img src="b.gif">' || CASE WHEN page_id % 3 < 2 THEN '<style data-source="s.css">p{background:url("data:image/gif;base64,R0lGODlh")}</style>' ELSE '<link rel="stylesheet" href="s.css">' END AS html,
       CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS inlined FROM pages""",
)
def inlined_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their images and style sheets put in, where there is an asset within the budget."""
    k = F.col("page_id")
    pages = load(spark, sf_dir, "pages").select("page_id", F.lit('<img src="a.gif"><img src="b.gif"><link rel="stylesheet" href="s.css">').alias("html"))
    gif = F.lit(b"GIF89a")
    css = F.when(k % 3 == 0, 'p{background:url(a.gif)}').otherwise("p{background:url('a2.gif')}").cast("binary")
    files = F.array(
        F.struct(F.when(k % 3 == 0, "a.gif").otherwise("a2.gif").alias("path"), gif.alias("content")), F.struct(F.lit("b.gif").alias("path"), F.concat(gif, F.repeat(F.lit("x"), 100).cast("binary")).alias("content")),
        F.struct(F.when(k % 3 < 2, "s.css").otherwise("t.css").alias("path"), css.alias("content")),
    )
    assets = pages.select("page_id", F.explode(files).alias("f")).select("page_id", "f.path", "f.content")
    made = repairs.embedded(pages, assets, "page_id", most=50)
    return made.select("page_id", "html", F.col("inlined").cast("int").alias("inlined"))

"""Provider payloads, figures, fetch policy and JSON results over payloads built from the tables' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers, publishers, results, safety
from ..functions import audit as page_audit
from ..functions.text import merge_extra, split_identifiers
from ..operators import batches, figures
from ..operators import candidates as cand
from ..sources.tables import load
from .registry import query
from .state_queries import pick


def k() -> Column:
    return F.col("p_partkey")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def doi() -> Column:
    """A DOI in one of three ways to write it."""
    return F.when(k() % 3 == 0, text("https://doi.org/10.1234/", k())).when(k() % 3 == 1, text("doi: 10.1234/", k(), ".")).otherwise(text("10.1234/", k()))


def title() -> Column:
    """A name with a reference and white space to collapse."""
    return text(F.col("p_name"), " &amp;  more\n")


NAMED = "p_name || ' & more'"


def _candidates(spark: SparkSession, sf_dir: str, provider: str, payload: Column, *fields: str) -> DataFrame:
    """Candidates of one provider: identifier, score, chosen fields, and their locations as one text."""
    rows = providers.with_candidate(load(spark, sf_dir, "part").select("p_partkey", F.to_json(payload).alias("payload")), provider, "payload", "c")
    places = F.array_join(F.transform("c.locations", lambda x: F.concat_ws(" ", x["kind"], x["url"])), ",")
    return rows.select("p_partkey", "c.source", "c.identifier", "c.score", *[F.element_at("c.fields", f).alias(f) for f in fields], places.alias("places"))


def provider(name: str, kind: str, oracle: str, payload: Callable[[], Column], *fields: str) -> None:
    """Register a query over the payloads of one provider."""

    @query(name, f"WITH p AS (SELECT *, p_partkey AS k, '10.1234/' || p_partkey AS doi, {NAMED} AS title, CAST(p_size AS VARCHAR) AS volume FROM part) {oracle}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _candidates(spark, sf_dir, kind, payload(), *fields)

    run.__doc__ = f"Payloads of {kind} as candidates with their locations."


provider(
    "openalex_candidates", "openalex",
    """SELECT k AS p_partkey, 'openalex' AS source, doi AS identifier, 1.0::DOUBLE AS score, title, doi AS "DOI", 'alpha beta alpha' AS "abstractNote", CASE WHEN k % 2 = 0 THEN '1-9' ELSE '1' END AS pages, 'pdf https://x/' || k || '.pdf,landing https://x/' || k AS places FROM p""",
    lambda: F.struct(
        title().alias("display_name"), F.struct(doi().alias("doi")).alias("ids"), F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(2)), F.lit("beta"), F.array(F.lit(1))).alias("abstract_inverted_index"),
        F.struct(F.lit("1").alias("first_page"), F.when(k() % 2 == 0, "9").otherwise("1").alias("last_page")).alias("biblio"), F.struct(text("https://x/", k()).alias("landing_page_url"), text("https://x/", k(), ".pdf").alias("pdf_url")).alias("primary_location"),
        F.array(F.struct(text("https://x/", k()).alias("landing_page_url"))).alias("locations"),
    ), "title", "DOI", "abstractNote", "pages",
)
provider(
    "unpaywall_candidates", "unpaywall",
    """SELECT k AS p_partkey, 'unpaywall' AS source, CASE WHEN k % 4 > 0 THEN doi ELSE title END AS identifier, CASE WHEN k % 4 > 0 THEN 1.0 ELSE 0.85 END::DOUBLE AS score, title, '2020' AS date, 'pdf https://u/' || k || '.pdf,landing https://u/' || k AS places FROM p""",
    lambda: F.struct(F.when(k() % 4 > 0, doi()).alias("doi"), title().alias("title"), F.lit(2020).alias("year"), F.struct(text("https://u/", k()).alias("url"), text("https://u/", k(), ".pdf").alias("url_for_pdf")).alias("best_oa_location")), "title", "date",
)
provider(
    "europe_pmc_candidates", "europe_pmc",
    """SELECT k AS p_partkey, 'europe_pmc' AS source, CASE WHEN k % 2 = 0 THEN doi ELSE CAST(k + 10000 AS VARCHAR) END AS identifier, 1.0::DOUBLE AS score, title, 'PMC' || (k + 20000) AS "PMCID", CAST(k + 10000 AS VARCHAR) AS "PMID", 'a b' AS "abstractNote",
       'html https://pmc.ncbi.nlm.nih.gov/articles/PMC' || (k + 20000) || '/,xml https://pmc.ncbi.nlm.nih.gov/api/oai/v1/mh/?verb=GetRecord&identifier=oai:pubmedcentral.nih.gov:' || (k + 20000) || '&metadataPrefix=pmc,landing https://pubmed.ncbi.nlm.nih.gov/' || (k + 10000) || '/,pdf https://e/' || k AS places FROM p""",
    lambda: F.struct(
        F.when(k() % 2 == 0, doi()).alias("doi"), text("PMID: ", k() + 10000).alias("pmid"), text("pmc", k() + 20000).alias("pmcid"), title().alias("title"), F.lit("<p>a</p> b").alias("abstractText"),
        F.struct(F.array(F.struct(text("https://e/", k()).alias("url"), F.lit("PDF").alias("documentStyle"))).alias("fullTextUrl")).alias("fullTextUrlList"),
    ), "title", "PMCID", "PMID", "abstractNote",
)
provider(
    "semantic_scholar_candidates", "semantic_scholar", """SELECT k AS p_partkey, 'semantic_scholar' AS source, doi AS identifier, 1.0::DOUBLE AS score, title, volume, CASE WHEN k % 2 = 0 THEN 'J & K' ELSE 'V' END AS "publicationTitle", 'pdf https://s/' || k || '.pdf,landing https://s/' || k AS places FROM p""",
    lambda: F.struct(title().alias("title"), F.struct(doi().alias("DOI")).alias("externalIds"), F.lit("V").alias("venue"), F.struct(F.when(k() % 2 == 0, "J &amp; K").alias("name"), F.col("p_size").alias("volume")).alias("journal"), text("https://s/", k()).alias("url"), F.struct(text("https://s/", k(), ".pdf").alias("url")).alias("openAccessPdf")),
    "title", "volume", "publicationTitle",
)
provider(
    "datacite_candidates", "datacite", """SELECT k AS p_partkey, 'datacite' AS source, doi AS identifier, 1.0::DOUBLE AS score, title, 'about' AS "abstractNote", '2019' AS date, 'pdf https://d/' || k || '.pdf,landing https://d/' || k AS places FROM p""",
    lambda: F.struct(F.struct(doi().alias("doi"), F.array(F.struct(F.lit(" ").alias("title")), F.struct(title().alias("title"))).alias("titles"), F.array(F.struct(F.lit("x").alias("description"), F.lit("Other").alias("descriptionType")), F.struct(F.lit("<b>about</b>").alias("description"), F.lit("Abstract").alias("descriptionType"))).alias("descriptions"), F.lit("2019").alias("publicationYear"), text("https://d/", k()).alias("url"), F.array(text("https://d/", k(), ".pdf")).alias("contentUrl")).alias("attributes")),
    "title", "abstractNote", "date",
)
provider(
    "preprint_server_candidates", "biorxiv", """SELECT k AS p_partkey, CASE WHEN k % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END AS source, doi AS identifier, 1.0::DOUBLE AS score, title, CASE WHEN k % 2 = 0 THEN 'bioRxiv' ELSE 'medRxiv' END AS repository,
       'html https://www.' || CASE WHEN k % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END || '.org/content/' || doi || ',pdf https://www.' || CASE WHEN k % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END || '.org/content/' || doi || '.full.pdf' AS places FROM p""",
    lambda: F.struct(doi().alias("doi"), title().alias("title"), F.when(k() % 2 == 1, "medRxiv").alias("server")), "title", "repository",
)
provider(
    "core_candidates", "core", """SELECT k AS p_partkey, 'core' AS source, doi AS identifier, 1.0::DOUBLE AS score, title, 'https://c/' || k || '.pdf' AS url, 'J' AS "publicationTitle", 'pdf https://c/' || k || '.pdf,landing https://c/' || k AS places FROM p""",
    lambda: F.struct(title().alias("title"), doi().alias("doi"), text("https://c/", k(), ".pdf").alias("downloadUrl"), F.array(text("https://c/", k()), text("https://c/", k(), ".pdf")).alias("sourceFulltextUrls"), F.array(F.struct(F.lit("J").alias("title"))).alias("journals")), "title", "url", "publicationTitle",
)
provider(
    "doaj_candidates", "doaj", """SELECT k AS p_partkey, 'doaj' AS source, CASE WHEN k % 2 = 0 THEN doi ELSE title END AS identifier, 1.0::DOUBLE AS score, title, '1234-5678, 8765-4321' AS "ISSN", 'html https://a/' || k || '.html' AS places FROM p""",
    lambda: F.struct(title().alias("title"), F.array(F.struct(F.when(k() % 2 == 0, "DOI").otherwise("issn").alias("type"), doi().alias("id"))).alias("identifier"), F.struct(F.lit("J").alias("title"), F.array(F.lit("1234-5678"), F.lit("8765-4321")).alias("issns")).alias("journal"), F.array(F.struct(text("https://a/", k(), ".html").alias("url"))).alias("link")),
    "title", "ISSN",
)
provider(
    "translator_candidates", "translator", """SELECT k AS p_partkey, 'zotero_translation_server_search' AS source, doi AS identifier, 0.9::DOUBLE AS score, title, CAST(123456 + k AS VARCHAR) AS "PMID", '2101.' || (10000 + k % 90000) AS "archiveLocation", 'landing https://t/' || k || ',pdf https://t/' || k || '.x' AS places FROM p""",
    lambda: F.struct(title().alias("title"), doi().alias("DOI"), text("https://t/", k()).alias("url"), text("PMID: ", k() + 123456, "; arXiv:2101.", 10000 + k() % 90000).alias("extra"), F.array(F.struct(text("https://t/", k(), ".x").alias("url"), F.lit("application/pdf").alias("mimeType")), F.struct(F.lit("file:///x").alias("url"), F.lit("text/html").alias("mimeType"))).alias("attachments")),
    "title", "PMID", "archiveLocation",
)


@query("openaire_candidates", f"""SELECT p_partkey, '10.1234/' || p_partkey AS identifier, {NAMED} AS title, CASE WHEN p_partkey % 2 = 0 THEN '2021-01-01' ELSE '' END AS date FROM part""")
def openaire_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads whose lists may be single objects."""
    value = lambda c: F.to_json(F.struct(c.alias("$")))
    one = F.concat(F.lit('{"pid":'), value(doi()), F.lit(',"title":'), value(title()), F.when(k() % 2 == 0, ',"dateofacceptance":{"$":"2021-01-01"}').otherwise(""), F.lit("}"))
    result = F.concat(F.lit('{"metadata":{"oaf:entity":{"oaf:result":'), one, F.lit("}}}"))
    payload = F.concat(F.lit('{"response":{"results":{"result":'), F.when(k() % 3 == 0, F.concat(F.lit("["), result, F.lit("]"))).otherwise(result), F.lit("}}}"))
    rows = load(spark, sf_dir, "part").select("p_partkey", providers.openaire(payload).alias("c"))
    return rows.select("p_partkey", "c.identifier", F.element_at("c.fields", "title").alias("title"), F.coalesce(F.element_at("c.fields", "date"), F.lit("")).alias("date"))


@query(
    "pubmed_articles",
    f"""SELECT p_partkey, CAST(p_partkey + 10000 AS VARCHAR) AS identifier, {NAMED} AS title, CASE WHEN p_partkey % 2 = 0 THEN '2020-03' ELSE '1999' END AS date, 'AIM: a A: b' AS abstract, '10.1234/' || p_partkey AS doi, 'Doe,The Group' AS authors FROM part""",
)
def pubmed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in XML: dates in words, labelled abstracts, authors and groups."""
    date = F.when(k() % 2 == 0, "<Year>2020</Year><Month>Mar</Month>").otherwise("<MedlineDate>Winter 1999-2000</MedlineDate>")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), (k() + 10000).cast("string"), F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>"), F.col("p_name"),
        F.lit(" &amp;amp;  more</ArticleTitle><Abstract><AbstractText Label='AIM'>a</AbstractText><AbstractText Label='A'>b</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation>"),
        F.lit("<PubmedData><ArticleIdList><ArticleId IdType='pubmed'>1</ArticleId><ArticleId IdType='doi'>10.1234/"), k().cast("string"), F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"),
    )
    # A table of names is few tasks by its size; an article takes about a tenth of a millisecond, so the rows are dealt out before.
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name").repartition("p_partkey")
    rows = providers.with_pubmed(parts.select("p_partkey", xml.alias("xml")), "xml", "c", "a")
    field = lambda f: F.element_at("c.fields", f)
    authors = F.array_join(F.transform("a", lambda x: F.coalesce(x["name"], x["lastName"])), ",")
    return rows.select("p_partkey", "c.identifier", field("title").alias("title"), field("date").alias("date"), field("abstractNote").alias("abstract"), field("DOI").alias("doi"), authors.alias("authors"))


@query("preprint_feed_entries", f"SELECT p_partkey, i AS pos, '2101.' || (10000 + p_partkey % 90000 + i) AS identifier, {NAMED} AS title, '2021-01-0' || (i + 1) AS date FROM part, (VALUES (0), (1)) v(i)")
def preprint_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of preprint feeds in XML."""
    entry = lambda i: text("<entry><id>http://arxiv.org/abs/2101.", 10000 + k() % 90000 + i, "v2</id><title>", F.col("p_name"), " &amp;amp;\n more</title><summary>s</summary><published>2021-01-0", F.lit(i + 1), "T00:00:00Z</published></entry>")
    feed = F.concat(F.lit("<feed>"), entry(0), entry(1), F.lit("</feed>"))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(providers.atom_entries(feed)).alias("pos", "c"))
    return rows.select("p_partkey", "pos", "c.identifier", F.element_at("c.fields", "title").alias("title"), F.element_at("c.fields", "date").alias("date"))


@query("citation_counts", "SELECT p_brand AS cited, count(DISTINCT p_size) AS citations FROM part GROUP BY 1")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each identifier is cited."""
    return providers.citation_counts(load(spark, sf_dir, "part").select(F.col("p_brand").alias("cited"), F.col("p_size").alias("citing")))


@query("provider_fan_out", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'by_id' WHEN p_partkey % 3 = 1 AND p_size >= 25 THEN 'by_title' END AS source FROM part")
def provider_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that counts for each item: by identifier, else by a title that is alike enough."""
    p = load(spark, sf_dir, "part")
    by_id = p.filter(k() % 3 == 0).select("p_partkey", F.lit(0).alias("ordinal"), F.lit(False).alias("by_title"), F.lit("by_id").alias("source"), F.lit(0.5).alias("score"))
    by_title = p.filter(k() % 3 < 2).select("p_partkey", F.lit(1).alias("ordinal"), F.lit(True).alias("by_title"), F.lit("by_title").alias("source"), (F.col("p_size") / 50.0).alias("score"))
    return cand.by_identifier(p.select("p_partkey"), by_id.unionByName(by_title), "p_partkey", 0.5).select("p_partkey", "source")


@query("lookup_texts", f"SELECT p_partkey, {NAMED} || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'f.pdf' AS haystack, CASE WHEN p_partkey % 2 = 0 THEN {NAMED} ELSE 'f & g.x' END AS title FROM part")
def lookup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of an item as one text, and the title to look it up by."""
    fields = F.create_map(F.lit("title"), F.regexp_replace(title(), "&amp;  more\n", "& more"), F.lit("empty"), F.lit(""), F.lit("brand"), F.col("p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", cand.lookup_text(fields, F.array("p_type", F.lit(None)), F.lit("f.pdf"), F.lit("")).alias("haystack"), cand.lookup_title(F.when(k() % 2 == 0, title()).otherwise(" "), F.lit("f &amp; g.x.pdf")).alias("title"))


@query("extra_lines_and_identifiers", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'PMID: 1' || chr(10) || 'b: ' || p_size ELSE 'b: ' || p_size END AS extra, p_brand || ',x' AS parts FROM part")
def extra_lines_and_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `extra` merged without repeats, and identifiers cut apart."""
    current = F.when(k() % 2 == 0, "PMID: 1").otherwise("")
    return load(spark, sf_dir, "part").select("p_partkey", merge_extra(current, F.when(k() % 2 == 0, text("pmid: 1\nb: ", F.col("p_size"))).otherwise(text("b: ", F.col("p_size")))).alias("extra"), F.array_join(split_identifiers(text(F.col("p_brand"), "; ;\nx")), ",").alias("parts"))


# --- figures and publishers ------------------------------------------------------------------------


@query("broken_figures_matched", "SELECT page_id, 0 AS figure, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS source, CASE WHEN page_id % 2 = 0 THEN 1500 ELSE 1700 END AS score FROM pages")
def broken_figures_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that a conversion broke, with the TeX source that fits best by environment, caption and label."""
    even = F.col("page_id") % 2 == 0
    tex = F.lit(r"\begin{figure}\begin{tikzpicture}x\end{tikzpicture}\caption{Energy plot}\label{fig:one}\end{figure} text \begin{figure*}\begin{pgfplot}y\end{pgfplot}\caption{Other {nested} thing}\end{figure*}")
    page = F.when(even, '<figure><span class="ltx_ERROR">pgfplot</span><figcaption>Other nested thing</figcaption></figure>').otherwise('<figure id="one"><span class="ltx_ERROR">tikzpicture</span><figcaption>Energy plot</figcaption></figure>')
    rows = load(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), page).alias("html"), tex.alias("tex"))
    return figures.matched(figures.broken_figures(rows, "page_id", "html"), figures.source_figures(rows, "page_id", "tex"), "page_id").select("page_id", "figure", "source", "score")


@query("publisher_pages", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<article><a data-rid="CIT1" href="#CIT1">1</a><p id="CIT1">r' || page_id || '</p></article>' WHEN 1 THEN '<article><a href="#Fig2">f' || page_id || '</a><figure id="Fig2">x</figure></article>'
    WHEN 2 THEN '<article><p>' || page_id || '</p></article>' ELSE '<article><a href="#s' || page_id || '">s</a><h2 id="s' || page_id || '">S</h2></article>' END AS html FROM pages""")
def publisher_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the handlers of four publishers make of their pages: local links, no furniture."""
    n = F.col("page_id")
    page = (
        F.when(n % 4 == 0, text('<article><a data-rid="CIT1">1</a><p id="CIT1" onclick="x()">r', n, "</p></article>")).when(n % 4 == 1, text('<article><a href="/articles/PMC1/figure/fig2/">f', n, '</a><figure id="Fig2">x</figure><div class="ctxp">z</div></article>'))
        .when(n % 4 == 2, text('<article><p style="color:#000">', n, '</p><span class="ltx_ERROR undefined">e</span></article>')).otherwise(text('<article><a href="https://link.springer.com/article/10.1/x#s', n, '">s</a><h2 id="s', n, '">S</h2></article>'))
    )
    kind = pick(("taylor_francis_article", "pmc_article", "arxiv_latexml", "springer_nature_article"), n % 4)
    return load(spark, sf_dir, "pages").select("page_id", publishers.normalize_page(page, kind, F.when(n % 4 == 3, "https://link.springer.com/article/10.1/x").otherwise("")).alias("html"))


@query("semantic_counts", "SELECT page_id, CAST(page_id % 3 AS INTEGER) AS section_total, CASE WHEN page_id % 3 > 0 THEN 1 ELSE 0 END AS section_annotated, 1 AS reference_total FROM pages")
def semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, figures and references of pages, and those with an id."""
    n = F.col("page_id")
    more = F.concat(pick(("", '<section id="a"></section>', '<section id="a"></section><section></section>'), n % 3), F.lit('<li id="bib1">r</li>'))
    rows = load(spark, sf_dir, "pages").select("page_id", page_audit.semantics(F.concat(F.coalesce("html", F.lit("")), more)).alias("s"))
    return rows.select("page_id", F.col("s.section_total").cast("int").alias("section_total"), F.col("s.section_annotated").cast("int").alias("section_annotated"), F.col("s.reference_total").cast("int").alias("reference_total"))


# --- fetch policy ----------------------------------------------------------------------------------

FETCHED = {
    "https://x.example.org/a": "ok", "http://127.0.0.1/a": "blocked_ip", "https://10.0.0.1/a": "blocked_ip", "file:///etc/passwd": "blocked_scheme", "http://a.localhost/": "blocked_host", "https://[::1]/a": "blocked_ip",
    "https://8.8.8.8/a": "ok", "": "empty_url", "ssh://x/a": "unsupported_scheme", "https:///a": "missing_host", "http://169.254.1.1/": "blocked_ip",
}
REQUESTS = {
    "https://own.org/a": "navigation", "http://own.org/a": "https_required", "https://u@own.org/": "credentials_forbidden", "https://own.org:8443/": "nonstandard_port", "https://10.0.0.1/": "blocked_ip", "https://other.org/": "cross_host_navigation_blocked", "https://sub.own.org/x": "navigation",
}
ASSETS = {"https://x/blobs/fig1.png": 0, "https://x/a.jpg": 1, "https://x/s.css": 2, "https://x/f.woff": 3, "https://x/logo.svg": 4}


def _cases(table: dict, column: str) -> str:
    return " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(table.values())).join((f"CASE {column} % {len(table)} ", " END"))


@query("fetch_policy", f"SELECT event_id, {_cases(FETCHED, 'event_id')} AS verdict, {_cases(REQUESTS, 'event_id')} AS decision, {_cases(ASSETS, 'event_id')} AS asset_rank FROM events")
def fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether URLs may be fetched, what a browser's policy says to a request, and in which order assets come."""
    n = F.col("event_id")
    of = lambda table: pick(tuple(table), n % len(table))
    e = load(spark, sf_dir, "events").select("event_id", of(FETCHED).alias("u"), of(REQUESTS).alias("r"), of(ASSETS).alias("a"))
    return e.select("event_id", safety.url_verdict(F.col("u")).alias("verdict"), safety.request_decision(F.col("r"), F.lit("https://own.org/"), F.lit(True), "own.org").alias("decision"), safety.asset_rank(F.col("a")).alias("asset_rank"))


IDENTITIES = ("title_match", "title_mismatch", "no_text_layer", "pdf_text_unavailable", "no_expected_title")


@query("pdf_identities", f"SELECT page_id, {_cases(dict(enumerate(IDENTITIES)), 'page_id')} AS identity FROM pages")
def pdf_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a PDF's first pages are those of the expected title, or why not."""
    n = F.col("page_id")
    words = "A remarkable zyzzyva experiment"
    body = F.when(n % 5 == 0, text("x " * 60, words, " ")).when(n % 5 == 1, "y " * 60).when(n % 5 == 2, "short").when(n % 5 == 4, "y " * 60)
    rows = load(spark, sf_dir, "pages").select("page_id", F.when(n % 5 == 4, "").otherwise(words).alias("title"), body.alias("text"))
    return rows.select("page_id", safety.pdf_identity(F.col("title"), F.col("text")).alias("identity"))


@query("retry_rules", "SELECT o_orderkey, o_orderkey % 10 IN (1, 2, 4, 5, 6, 7, 8, 9) AS pdf_retry, CAST(CASE o_orderkey % 3 WHEN 0 THEN 30.0 WHEN 1 THEN NULL ELSE 1.5 END AS DOUBLE) AS wait FROM orders")
def retry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which HTTP codes are tried again, and how long a server asks to wait."""
    n = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, (404, 408, 409, 403, 425, 429, 500, 502, 503, 504))), (n % 10 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", safety.pdf_retryable(F.lit("http_error"), code).alias("pdf_retry"), providers.retry_after(pick(("30", "soon", " 1.5 "), n % 3)).alias("wait"))


@query("file_names", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a b ' || c_custkey WHEN 1 THEN '_CON.' || c_custkey ELSE 'document' END AS name FROM customer")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that all file systems accept."""
    n = F.col("c_custkey")
    value = F.when(n % 3 == 0, text("a/b: ", n, " . ")).when(n % 3 == 1, text("CON.", n)).otherwise(" <> ")
    return load(spark, sf_dir, "customer").select("c_custkey", safety.safe_filename(value).alias("name"))


@query("final_errors", "SELECT event_id, event_id % 3 = 0 AS final FROM events")
def final_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a configuration, which no retry mends."""
    n = F.col("event_id")
    message = F.when(n % 3 == 0, text("x ", n, ": Parent item version is unavailable")).otherwise(text("HTTP 503 ", n))
    return load(spark, sf_dir, "events").select("event_id", safety.is_final_error(message, ["not configured", "version is unavailable"]).alias("final"))


# --- results ---------------------------------------------------------------------------------------


@query("json_results", """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"k":"' || json_extract_string(props, '$.k') || '","s":"' || event_type || '"}' AS patched, event_id % 4 <> 0 AS strict, event_id % 5 + event_id % 2 AS failures FROM events""")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, patches, strictness and failure counts of stored JSON."""
    n = F.col("event_id")
    e = load(spark, sf_dir, "events")
    raw = F.when(n % 4 == 0, '{"a":1,"a":2}').otherwise(F.col("props"))
    batch = F.to_json(F.struct((n % 5).alias("failed"), F.when(n % 2 == 1, 1).alias("problem_documents")))
    return e.select("event_id", *results.project_json(F.col("props"), {"k": "$.k"}), results.patch_json(F.col("props"), {"s": F.col("event_type")}).alias("patched"), results.is_strict_json(raw).alias("strict"), results.failure_count(batch).alias("failures"))


@query(
    "batch_totals",
    """SELECT o_orderpriority AS batch, count(*) AS processed, count(*) FILTER (o_orderkey % 5 < 2) AS failed, count(*) FILTER (o_orderkey % 5 = 0) AS failed_retryable_jobs, count(*) FILTER (o_orderkey % 5 = 1) AS failed_final_jobs,
       count(*) FILTER (o_orderkey % 3 = 0) AS html_found, CAST(sum(o_orderkey % 4) AS BIGINT) AS browser_pdf_fallbacks FROM orders GROUP BY 1""",
)
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of a drain did."""
    n = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), pick(("failed_retryable", "failed_final", "succeeded", "skipped", "succeeded"), n % 5).alias("status"), F.when(n % 2 == 0, n % 3 == 0).when(n % 3 == 0, True).alias("html_found"), (n % 4).alias("browser_pdf_fallbacks"))
    return batches.totals(rows, ["batch"], ["html_found"])


@query("batch_checks", """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'batch ok must be an exact boolean' WHEN 1 THEN 'batch failed count cannot exceed processed count' WHEN 2 THEN 'batch results count must equal processed count' WHEN 3 THEN 'batch failed count must match failed job statuses' END AS reason FROM supplier""")
def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batch results are not to be believed."""
    n = F.col("s_suppkey") % 5
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.when(n > 0, True).alias("ok"), F.lit(4).alias("processed"), F.when(n == 1, 5).otherwise(2).alias("failed"), F.when(n == 2, 3).otherwise(4).alias("jobs"), F.lit(1).alias("failed_retryable_jobs"), F.when(n == 3, 2).otherwise(1).alias("failed_final_jobs"))
    return batches.valid(rows).select("s_suppkey", "reason")


@query(
    "drain_stop_points",
    """WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_id % 5 < 2) AS failed, count(*) FILTER (event_id % 5 = 0) AS r FROM events GROUP BY 1, 2)
       SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(sum(failed) OVER w AS BIGINT) AS total_failed, sum(failed) OVER w >= 5 OR sum(r) OVER w >= 3 AS stop FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
)
def drain_stop_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each drain stops for its failures."""
    n = F.col("event_id")
    rows = load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count_if(n % 5 < 2).alias("failed"), F.count_if(n % 5 == 0).alias("failed_retryable_jobs"))
    return batches.stop_points(rows, ["day"], 5, 3, ["user_id"]).select("user_id", "day", "total_failed", "stop")


@query(
    "host_cooldowns",
    """SELECT event_id, greatest(0.0, coalesce(CASE WHEN lag(event_id % 4) OVER w = 0 THEN 7200.0 ELSE 60.0 END - (epoch(ts) - lag(epoch(ts)) OVER w), 0.0)) > 0 AS waits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def host_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come too soon behind the one before, longer waits behind refusals."""
    rows = load(spark, sf_dir, "events").withColumns({"status": F.when(F.col("event_id") % 4 == 0, 429).otherwise(200), "cool": F.lit(7200.0)})
    return batches.wait_for_host(rows, "user_id", "ts", F.lit(60.0), F.col("cool")).select("event_id", (F.col("wait_seconds") > 0).alias("waits"))

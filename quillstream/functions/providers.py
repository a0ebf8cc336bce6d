"""Provider payloads (JSON, XML) as candidate structs: source, identifier, score, fields, locations.

Payloads are read with explicit schemas, so only the named paths are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls
from .identifiers import extract_arxiv_id, extract_pmcid, extract_pmid, normalize_arxiv_id, normalize_doi, normalize_pmcid, normalize_pmid
from .text import blank, first_text, none_if_blank, normalize_space, strip_html

#: Schema of each provider's payload; only these paths are parsed.
SCHEMAS = {
    "crossref": """DOI string, title array<string>, URL string, `container-title` array<string>, `short-container-title` array<string>, ISSN array<string>, volume string, issue string, page string,
        abstract string, link array<struct<URL:string,`content-type`:string>>, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>,
        published struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>""",
    "openalex": """display_name string, doi string, ids struct<doi:string>, publication_date string, publication_year string, abstract_inverted_index map<string,array<int>>, id string,
        biblio struct<volume:string,issue:string,first_page:string,last_page:string>, primary_location struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string,issn:array<string>>>,
        locations array<struct<landing_page_url:string,pdf_url:string>>""",
    "unpaywall": """doi string, title string, year string, journal_name string, journal_issns string, publisher string, doi_url string, best_oa_location struct<url:string,url_for_pdf:string,url_for_landing_page:string>,
        oa_locations array<struct<url:string,url_for_pdf:string,url_for_landing_page:string>>""",
    "europe_pmc": """pmid string, pmcid string, doi string, title string, journalTitle string, pubYear string, abstractText string, journalVolume string, issue string, pageInfo string,
        fullTextUrlList struct<fullTextUrl:array<struct<url:string,documentStyle:string>>>""",
    "semantic_scholar": """title string, externalIds struct<DOI:string,PubMed:string>, abstract string, publicationDate string, year string, venue string, journal struct<name:string,volume:string,pages:string>, url string,
        openAccessPdf struct<url:string>""",
    "datacite": """id string, attributes struct<doi:string,titles:array<struct<title:string>>,descriptions:array<struct<description:string,descriptionType:string>>,published:string,publicationYear:string,publisher:string,url:string,contentUrl:array<string>>""",
    "biorxiv": "doi string, title string, abstract string, date string, url string, published string, server string",
    "core": "title string, doi string, abstract string, publishedDate string, yearPublished string, downloadUrl string, fullTextLink string, sourceFulltextUrls array<string>, journals array<struct<title:string>>",
    "doaj": "title string, abstract string, year string, month string, identifier array<struct<type:string,id:string>>, journal struct<title:string,publisher:string,issns:array<string>>, link array<struct<url:string,type:string>>",
    "translator": "title string, DOI string, abstractNote string, date string, publicationTitle string, ISSN string, volume string, issue string, pages string, ISBN string, url string, archiveLocation string, PMID string, PMCID string, extra string, attachments array<struct<url:string,mimeType:string,title:string>>",
}
PUBMED = """MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Journal:struct<Title:string,ISOAbbreviation:string,ISSN:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,
Pagination:struct<MedlinePgn:string>,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string>>>>,
DateCompleted:struct<Year:string,Month:string,Day:string>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"""
ATOM = "entry array<struct<id:string,title:string,summary:string,published:string,doi:string>>"


LOCATION = "struct<source:string,url:string,kind:string,content_type:string>"


def partial_date(*parts: Column) -> Column:
    """Year, or year and month, or all three, as text; later parts need the earlier ones."""
    year, *rest = [F.trim(blank(p)) for p in parts]
    out, ok = year, year != ""
    for part in rest:
        ok = ok & part.rlike("^[0-9]+$")
        out = F.when(ok, F.concat(out, F.lit("-"), F.when(F.length(part) >= 2, part).otherwise(F.lpad(part, 2, "0")))).otherwise(out)
    return F.when(year == "", "").otherwise(out)


def compact_pages(first: Column, last: Column) -> Column:
    a, b = normalize_space(first), normalize_space(last)
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit("-"), b)).otherwise(F.coalesce(none_if_blank(a), b))


# English month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_number(value: Column) -> Column:
    """Two digits for a month's name or number; empty for anything else."""
    text = F.lower(F.trim(blank(value)))
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    digits = F.when(text.rlike("^(0?[1-9]|1[0-2])$"), F.lpad(text, 2, "0"))
    return F.coalesce(digits, F.element_at(table, F.substring(text, 1, 3)), F.lit(""))


def inverted_text(index: Column) -> Column:
    """Text from a map of words to their places, ties by word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def not_blank(fields: Column) -> Column:
    """A map of fields without the blank ones, references decoded and white space collapsed."""
    return F.map_filter(F.transform_values(fields, lambda k, v: normalize_space(v)), lambda k, v: v != "")


def field_map(**fields: Column) -> Column:
    return not_blank(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]))


def _joined(*parts: Column) -> Column:
    """Arrays of locations as one, null arrays as empty, the first of each URL."""
    return first_urls(F.concat(*[F.coalesce(p, F.array().cast(f"array<{LOCATION}>")) for p in parts]))


def first_urls(locations: Column) -> Column:
    """Locations without blank URLs and without those that repeat an earlier URL."""
    some = F.filter(locations, lambda x: blank(x["url"]) != "")
    seen = F.transform(some, lambda x: x["url"])
    return F.filter(some, lambda x, i: F.array_position(seen, x["url"]) == i + 1)


def _location(source: Column | str, url: Column, kind: Column | str, content_type: Column | None = None) -> Column:
    return F.struct((F.lit(source) if isinstance(source, str) else source).alias("source"), blank(url).alias("url"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit("") if content_type is None else blank(content_type)).alias("content_type"))


def candidate(source: Column | str, identifier: Column, score: Column | float, fields: Column, locations: Column, ok: Column) -> Column:
    """A candidate struct, null where the payload names neither a title nor an identifier."""
    value = F.struct((F.lit(source) if isinstance(source, str) else source).alias("source"), identifier.alias("identifier"), (score if isinstance(score, Column) else F.lit(float(score))).cast("double").alias("score"), fields.alias("fields"), locations.alias("locations"))
    return F.when(ok, value)


def _both(doi: Column, title: Column) -> Column:
    """Score of payloads found by DOI: lower where they only have a title."""
    return F.when(doi != "", 1.0).otherwise(0.85)


def _texts(values: Column, name: str = "") -> Column:
    """An array of strings, or of one field of structs; null is empty."""
    return F.coalesce(F.transform(values, lambda v: v[name]) if name else values, F.array().cast("array<string>"))


def crossref_date(w: Column) -> Column:
    """The first date among print, online, published, issued and created."""
    parts = [F.get(w[k]["date-parts"], F.lit(0)) for k in ("published-print", "published-online", "published", "issued", "created")]
    dates = [F.when(F.size(p) > 0, partial_date(*[F.get(p, F.lit(i)).cast("string") for i in range(3)])) for p in parts]
    return F.coalesce(*[none_if_blank(d) for d in dates], F.lit(""))


def crossref(w: Column, score: float = 1.0) -> Column:
    doi, title = normalize_doi(w["DOI"]), first_text(w["title"])
    fields = field_map(
        title=title, DOI=doi, url=w["URL"], date=crossref_date(w), publicationTitle=first_text(w["container-title"]), ISSN=F.array_join(w["ISSN"], ", "), volume=w["volume"], issue=w["issue"],
        pages=w["page"], journalAbbreviation=first_text(w["short-container-title"]), libraryCatalog=F.lit("Crossref"), abstractNote=strip_html(w["abstract"]),
    )
    links = F.transform(w["link"], lambda x: _location("crossref", x["URL"], urls.link_kind(x["URL"], x["content-type"]), x["content-type"]))
    return candidate("crossref", F.coalesce(none_if_blank(doi), title), score, fields, _joined(links, F.array(_location("crossref", w["URL"], "landing"))), (doi != "") | (title != ""))


def openalex(w: Column, score: float = 1.0) -> Column:
    doi, title, biblio, place = normalize_doi(F.coalesce(w["ids"]["doi"], w["doi"])), normalize_space(w["display_name"]), w["biblio"], w["primary_location"]
    fields = field_map(
        title=title, abstractNote=inverted_text(w["abstract_inverted_index"]), DOI=doi, date=F.coalesce(w["publication_date"], w["publication_year"]), publicationTitle=place["source"]["display_name"],
        ISSN=F.array_join(place["source"]["issn"], ", "), volume=biblio["volume"], issue=biblio["issue"], pages=compact_pages(biblio["first_page"], biblio["last_page"]),
        url=F.coalesce(place["landing_page_url"], w["id"]), libraryCatalog=F.lit("OpenAlex"),
    )
    own = F.array(_location("openalex", place["pdf_url"], "pdf"), _location("openalex", place["landing_page_url"], "landing"))
    others = F.flatten(F.transform(w["locations"], lambda p: F.array(_location("openalex", p["pdf_url"], "pdf"), _location("openalex", p["landing_page_url"], "landing"))))
    return candidate("openalex", F.coalesce(none_if_blank(doi), title), score, fields, _joined(own, others), (doi != "") | (title != ""))


def unpaywall(w: Column) -> Column:
    doi, title, best = normalize_doi(w["doi"]), normalize_space(w["title"]), w["best_oa_location"]
    place = lambda p: F.array(_location("unpaywall", p["url_for_pdf"], "pdf"), _location("unpaywall", p["url_for_landing_page"], "landing"), _location("unpaywall", p["url"], "landing"))
    fields = field_map(
        title=title, DOI=doi, date=w["year"], publicationTitle=w["journal_name"], ISSN=w["journal_issns"], publisher=w["publisher"],
        url=F.coalesce(best["url_for_landing_page"], best["url"], w["doi_url"]), libraryCatalog=F.lit("Unpaywall"),
    )
    return candidate("unpaywall", F.coalesce(none_if_blank(doi), title), _both(doi, title), fields, _joined(place(best), F.flatten(F.transform(w["oa_locations"], place))), (doi != "") | (title != ""))


def europe_pmc(w: Column, score: float = 1.0) -> Column:
    doi, pmid, pmcid, title = normalize_doi(w["doi"]), normalize_pmid(w["pmid"]), normalize_pmcid(w["pmcid"]), normalize_space(w["title"])
    fields = field_map(
        title=title, DOI=doi, PMID=pmid, PMCID=pmcid, publicationTitle=w["journalTitle"], date=w["pubYear"], abstractNote=strip_html(w["abstractText"]), volume=w["journalVolume"], issue=w["issue"],
        pages=w["pageInfo"], libraryCatalog=F.lit("Europe PMC"),
    )
    page = lambda before, x, after="": F.when(x != "", F.concat(F.lit(before), x, F.lit(after)))
    number = F.regexp_replace(pmcid, "^PMC", "")
    own = F.array(
        _location("europe_pmc", page("https://pmc.ncbi.nlm.nih.gov/articles/", pmcid, "/"), "html"),
        _location("pmc_oai", page("https://pmc.ncbi.nlm.nih.gov/api/oai/v1/mh/?verb=GetRecord&identifier=oai:pubmedcentral.nih.gov:", number, "&metadataPrefix=pmc"), "xml", F.lit("application/xml")),
        _location("europe_pmc", page("https://pubmed.ncbi.nlm.nih.gov/", pmid, "/"), "landing"),
    )
    listed = F.transform(w["fullTextUrlList"]["fullTextUrl"], lambda x: _location("europe_pmc", x["url"], F.coalesce(none_if_blank(F.lower(normalize_space(x["documentStyle"]))), F.lit("landing"))))
    return candidate("europe_pmc", F.coalesce(*[none_if_blank(c) for c in (doi, pmid, pmcid, title)]), score, fields, _joined(own, listed), (doi != "") | (title != ""))


def semantic_scholar(w: Column, score: float = 1.0) -> Column:
    doi, title, journal = normalize_doi(w["externalIds"]["DOI"]), normalize_space(w["title"]), w["journal"]
    fields = field_map(
        title=title, abstractNote=w["abstract"], DOI=doi, PMID=normalize_pmid(w["externalIds"]["PubMed"]), date=F.coalesce(w["publicationDate"], w["year"]), publicationTitle=F.coalesce(journal["name"], w["venue"]),
        volume=journal["volume"], pages=journal["pages"], url=w["url"], libraryCatalog=F.lit("Semantic Scholar"),
    )
    places = F.array(_location("semantic_scholar", w["openAccessPdf"]["url"], "pdf"), _location("semantic_scholar", w["url"], "landing"))
    return candidate("semantic_scholar", F.coalesce(none_if_blank(doi), title), score, fields, _joined(places), (doi != "") | (title != ""))


def datacite(w: Column) -> Column:
    a = w["attributes"]
    doi, title = normalize_doi(F.coalesce(a["doi"], w["id"])), first_text(_texts(a["titles"], "title"))
    abstracts = F.filter(a["descriptions"], lambda d: F.lower(blank(d["descriptionType"])).isin("abstract", "description"))
    fields = field_map(
        title=title, abstractNote=strip_html(first_text(_texts(abstracts, "description"))), DOI=doi, date=F.coalesce(a["published"], a["publicationYear"]), publisher=a["publisher"], url=a["url"], libraryCatalog=F.lit("DataCite")
    )
    files = F.transform(a["contentUrl"], lambda u: _location("datacite", u, urls.link_kind(u, F.lit(""))))
    return candidate("datacite", F.coalesce(none_if_blank(doi), title), _both(doi, title), fields, _joined(files, F.array(_location("datacite", a["url"], "landing"))), (doi != "") | (title != ""))


def biorxiv(w: Column) -> Column:
    """Preprint servers; the payload names its server."""
    doi, title, server = normalize_doi(w["doi"]), normalize_space(w["title"]), F.coalesce(none_if_blank(F.lower(blank(w["server"]))), F.lit("biorxiv"))
    page = F.when(doi != "", F.concat(F.lit("https://www."), server, F.lit(".org/content/"), doi))
    landing, name = F.coalesce(none_if_blank(normalize_space(w["url"])), page), F.when(server == "biorxiv", "bioRxiv").otherwise("medRxiv")
    extra = F.when(blank(w["published"]) != "", F.concat(F.lit("Published DOI: "), normalize_doi(w["published"])))
    fields = field_map(title=title, abstractNote=w["abstract"], DOI=doi, date=w["date"], publicationTitle=name, repository=name, url=landing, libraryCatalog=server, extra=extra)
    places = F.array(_location(server, landing, "html"), _location(server, F.concat(page, F.lit(".full.pdf")), "pdf"))
    return candidate(server, F.coalesce(none_if_blank(doi), title), _both(doi, title), fields, _joined(places), (doi != "") | (title != ""))


def core(w: Column, score: float = 1.0) -> Column:
    doi, title = normalize_doi(w["doi"]), normalize_space(w["title"])
    links = F.concat(F.array(w["downloadUrl"], w["fullTextLink"]), _texts(w["sourceFulltextUrls"]))
    fields = field_map(title=title, abstractNote=w["abstract"], DOI=doi, date=F.coalesce(w["publishedDate"], w["yearPublished"]), publicationTitle=first_text(_texts(w["journals"], "title")), url=first_text(links), libraryCatalog=F.lit("CORE"))
    return candidate("core", F.coalesce(none_if_blank(doi), title), score, fields, _joined(F.transform(links, lambda u: _location("core", u, urls.link_kind(u, F.lit(""))))), (doi != "") | (title != ""))


def doaj(w: Column, score: float = 1.0) -> Column:
    found = F.filter(w["identifier"], lambda x: F.lower(blank(x["type"])) == "doi")
    doi, title, journal = normalize_doi(first_text(_texts(found, "id"))), normalize_space(w["title"]), w["journal"]
    fields = field_map(
        title=title, abstractNote=w["abstract"], DOI=doi, date=F.coalesce(w["year"], w["month"]), publicationTitle=journal["title"], ISSN=F.array_join(journal["issns"], ", "), publisher=journal["publisher"],
        url=first_text(_texts(w["link"], "url")), libraryCatalog=F.lit("DOAJ"),
    )
    links = F.transform(w["link"], lambda x: _location("doaj", x["url"], urls.link_kind(x["url"], F.lit(""))))
    return candidate("doaj", F.coalesce(none_if_blank(doi), title), score, fields, _joined(links), (doi != "") | (title != ""))


def translator(w: Column, score: float = 0.9) -> Column:
    """Items of a translation service: identifiers that have no field of their own are read from the text."""
    doi, title = normalize_doi(w["DOI"]), normalize_space(w["title"])
    rest = F.concat_ws("\n", w["title"], w["url"], w["extra"], w["abstractNote"])
    fields = field_map(
        title=title, abstractNote=strip_html(w["abstractNote"]), date=w["date"], publicationTitle=w["publicationTitle"], DOI=doi, ISSN=w["ISSN"], volume=w["volume"], issue=w["issue"], pages=w["pages"], ISBN=w["ISBN"],
        url=w["url"], archiveLocation=F.coalesce(none_if_blank(blank(w["archiveLocation"])), extract_arxiv_id(rest)), PMID=F.coalesce(none_if_blank(blank(w["PMID"])), extract_pmid(rest)),
        PMCID=F.coalesce(none_if_blank(blank(w["PMCID"])), extract_pmcid(rest)), extra=w["extra"], libraryCatalog=F.lit("Zotero translators"),
    )
    web = lambda u: F.when(F.lower(blank(u)).rlike("^https?://"), u)
    files = F.transform(w["attachments"], lambda x: _location("zotero_translation_server_attachment", web(x["url"]), urls.link_kind(x["url"], x["mimeType"]), x["mimeType"]))
    places = _joined(F.array(_location("zotero_translation_server", web(w["url"]), urls.link_kind(w["url"], F.lit("")))), files)
    return candidate("zotero_translation_server_search", F.coalesce(none_if_blank(doi), title), score, fields, places, (doi != "") | (title != ""))


def openaire(payload: Column) -> Column:
    """Payloads whose lists may be single objects, so they are read as variants."""
    v = F.try_parse_json(payload)
    at = lambda path: F.coalesce(*[F.try_variant_get(v, f"$.response.results.result{i}.metadata['oaf:entity']['oaf:result']{path}", "string") for i in ("[0]", "")])
    value = lambda name: F.coalesce(at(f".{name}[0]['$']"), at(f".{name}['$']"), at(f".{name}"))
    doi, title = normalize_doi(value("pid")), normalize_space(value("title"))
    fields = field_map(title=title, abstractNote=value("description"), DOI=doi, date=value("dateofacceptance"), publicationTitle=value("journal"), publisher=value("publisher"), libraryCatalog=F.lit("OpenAIRE"))
    return candidate("openaire", F.coalesce(none_if_blank(doi), title), 1.0, fields, _joined(F.array().cast(f"array<{LOCATION}>")), (doi != "") | (title != ""))


def pubmed_record(w: Column) -> Column:
    """One parsed article element."""
    cite, a = w["MedlineCitation"], w["MedlineCitation"]["Article"]
    ids = w["PubmedData"]["ArticleIdList"]["ArticleId"]
    of = lambda kind: first_text(_texts(F.filter(ids, lambda x: F.lower(blank(x["_IdType"])) == kind), "_VALUE"))
    issue, done = a["Journal"]["JournalIssue"], cite["DateCompleted"]
    year = F.coalesce(issue["PubDate"]["Year"], F.regexp_substr(issue["PubDate"]["MedlineDate"], F.lit(r"\d{4}")))
    date = F.when(year.isNotNull(), partial_date(year, month_number(issue["PubDate"]["Month"]), issue["PubDate"]["Day"])).otherwise(partial_date(done["Year"], month_number(done["Month"]), done["Day"]))
    parts = F.filter(a["Abstract"]["AbstractText"], lambda p: blank(p["_VALUE"]) != "")
    abstract = F.array_join(F.transform(parts, lambda p: F.concat(F.when(blank(p["_Label"]) != "", F.concat(normalize_space(p["_Label"]), F.lit(": "))).otherwise(""), strip_html(p["_VALUE"]))), "\n")
    pmid, title = normalize_pmid(cite["PMID"]), normalize_space(a["ArticleTitle"])
    # Line ends between labelled parts stay, so the abstract joins the map behind the collapsing.
    fields = field_map(
        title=title, date=date, publicationTitle=a["Journal"]["Title"], journalAbbreviation=a["Journal"]["ISOAbbreviation"], volume=issue["Volume"], issue=issue["Issue"], pages=a["Pagination"]["MedlinePgn"], abstractNote=abstract,
        ISSN=a["Journal"]["ISSN"], DOI=normalize_doi(of("doi")), PMID=pmid, PMCID=normalize_pmcid(of("pmc")), url=F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))), libraryCatalog=F.lit("PubMed"),
    )
    return candidate("pubmed", pmid, 1.0, fields, F.array().cast(f"array<{LOCATION}>"), (pmid != "") | (title != ""))


def pubmed_record_authors(w: Column) -> Column:
    """Authors of a parsed article: a collective name, or first and last name with initials."""
    rows = w["MedlineCitation"]["Article"]["AuthorList"]["Author"]
    return F.transform(rows, lambda x: F.struct(x["CollectiveName"].alias("name"), x["ForeName"].alias("firstName"), x["LastName"].alias("lastName"), x["Initials"].alias("initials")))


def pubmed(article: Column) -> Column:
    """One article element as XML, parsed once: as the value of a lambda it has a name."""
    return F.get(F.transform(F.array(F.from_xml(article, PUBMED)), pubmed_record), F.lit(0))


def pubmed_authors(article: Column) -> Column:
    return pubmed_record_authors(F.from_xml(article, PUBMED))


def with_pubmed(rows: DataFrame, article: str, out: str = "candidate", authors: str = "authors") -> DataFrame:
    """Add the candidate and the authors of an XML column; the article is parsed once for both, in a projection of its own."""
    parsed = rows.withColumn("_article", F.from_xml(article, PUBMED))
    return parsed.withColumns({out: pubmed_record(F.col("_article")), authors: pubmed_record_authors(F.col("_article"))}).drop("_article")


def atom_entries(feed: Column) -> Column:
    """Entries of a preprint feed as candidates (an array)."""
    f = F.from_xml(feed, ATOM)

    def entry(e: Column) -> Column:
        own = normalize_arxiv_id(F.regexp_replace(e["id"], r"^https?://arxiv\.org/abs/", ""))
        fields = field_map(title=e["title"], abstractNote=e["summary"], date=F.substring(e["published"], 1, 10), DOI=normalize_doi(e["doi"]), archive=F.lit("arXiv"), archiveLocation=own)
        return candidate("arxiv", own, 1.0, fields, F.array(_location("arxiv", F.concat(F.lit("https://arxiv.org/html/"), own), "html")), own != "")

    return F.array_compact(F.transform(F.coalesce(f["entry"], F.array().cast("array<struct<id:string,title:string,summary:string,published:string,doi:string>>")), entry))


#: Mappers over a parsed payload, by provider.
MAPPERS = {f.__name__: f for f in (crossref, openalex, unpaywall, europe_pmc, semantic_scholar, datacite, biorxiv, core, doaj, translator)}


def with_candidate(rows: DataFrame, provider: str, payload: str, out: str = "candidate") -> DataFrame:
    """Add the candidate of a JSON payload column; the payload is parsed once, in a projection of its own."""
    parsed = rows.withColumn("_payload", F.from_json(payload, SCHEMAS[provider]))
    return parsed.withColumn(out, MAPPERS[provider](F.col("_payload"))).drop("_payload")


def retry_after(value: Column) -> Column:
    """Seconds in a Retry-After header: a number; null for anything else."""
    return F.when(F.trim(blank(value)).rlike(r"^\d+(\.\d+)?$"), F.trim(value).cast("double"))


def citation_counts(edges: DataFrame, cited: str = "cited") -> DataFrame:
    """How often each identifier is cited, by distinct citing identifiers."""
    return edges.distinct().groupBy(cited).agg(F.count(F.lit(1)).alias("citations"))

"""Parts of URLs, their normal form for probing, and publisher rules, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Hosts and path patterns of full articles and of abstract pages.
FULL_ARTICLE = (
    ("pmc.ncbi.nlm.nih.gov", "/articles/"), ("frontiersin.org", "/full$"), ("tandfonline.com", "^/doi/full/"), ("link.springer.com", "^/article/"),
    ("iopscience.iop.org", "^/article/"), ("ar5iv.labs.arxiv.org", "^/html/"), ("arxiv.org", "^/html/"), ("thieme-connect.de", "/products/ejournals/html/"),
)
ABSTRACT_OR_CHAPTER = (("thieme-connect.de", "/products/ejournals/abstract/"), ("link.springer.com", "^/chapter/"), ("pubs.acs.org", "^/doi/"))
PROBED_KINDS = ("html", "landing", "fulltext", "webpage", "article", "doi")


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if missing."""
    return F.regexp_extract(F.trim(blank(url)), _PARTS, group)


def host(url: Column) -> Column:
    return F.substring_index(F.lower(part(url, 2)), ":", 1)


def path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def normalized_probe_url(url: Column) -> Column:
    """Scheme and authority in lower case, without parameters and fragment."""
    scheme, authority, query = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 4)
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), F.when(authority == "", "").otherwise(F.concat(F.lit("//"), authority)),
        path(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def in_domain(url: Column, domain: str) -> Column:
    """Whether the host is a domain, one of its subdomains, or ends in its name."""
    return host(url).endswith(domain)


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def is_pdf_url(url: Column) -> Column:
    p = F.lower(path(url))
    return p.endswith(".pdf") | F.contains(p, F.lit("/pdf/")) | p.endswith("/pdf")


def is_supplement_url(url: Column) -> Column:
    return F.contains(F.lower(F.substring_index(path(url), "/", -1)), F.lit("supplement"))


def is_article_view_url(url: Column) -> Column:
    """Whether the first `article` segment of the path is followed by `view` and an id."""
    return F.regexp_extract(F.regexp_replace(F.lower(path(url)), "/+$", ""), "(?:^|/)article/+(view/+[^/]+)?", 1) != ""


def _rules(url: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    h, p = host(url), F.lower(path(url))
    found = F.lit(False)
    for domain, pattern in rules:
        found = found | (h.endswith(domain) & p.rlike(pattern))
    return found


def is_full_article_url(url: Column) -> Column:
    return _rules(url, FULL_ARTICLE) | is_article_view_url(url)


def is_abstract_or_chapter_url(url: Column) -> Column:
    return _rules(url, ABSTRACT_OR_CHAPTER)


def is_preprint_landing(url: Column) -> Column:
    return in_domain(url, "arxiv.org") & F.lower(path(url)).startswith("/abs/")


def preprint_id(url: Column) -> Column:
    """The identifier in a preprint's abstract or HTML URL, without its version; empty if there is none."""
    h = host(url)
    own = h.endswith("arxiv.org") & F.lower(path(url)).rlike("^/+(abs|html)/")
    mirror = h.endswith("ar5iv.labs.arxiv.org") & F.lower(path(url)).rlike("^/+html/")
    found = F.regexp_replace(F.trim(F.regexp_extract(path(url), "^/+[^/]+/+([^/]+)", 1)), r"(?i)v\d+$", "")
    return F.when(own | mirror, found).otherwise("")


def is_pdf_location(kind: Column, content_type: Column, url: Column) -> Column:
    return (F.lower(blank(kind)) == "pdf") | F.contains(F.lower(blank(content_type)), F.lit("pdf")) | is_pdf_url(url)


def probes_for_html(kind: Column, content_type: Column, url: Column) -> Column:
    return (blank(url) != "") & ~is_pdf_location(kind, content_type, url) & F.lower(blank(kind)).isin(*PROBED_KINDS)


def probe_rank(kind: Column, content_type: Column, url: Column) -> Column:
    """Order in which locations are probed: a struct that sorts ascending."""
    u, k = F.lower(blank(url)), F.lower(blank(kind))
    preprint = F.when(in_domain(url, "ar5iv.labs.arxiv.org"), 1).when(in_domain(url, "arxiv.org") & F.lower(path(url)).startswith("/html/"), 0).otherwise(2)
    fits = probes_for_html(kind, content_type, url)
    return F.struct(
        F.when(~fits, 3).when(k == "html", 0).otherwise(1).alias("direct"), F.when(fits, preprint).otherwise(9).alias("preprint"),
        F.when(~fits, 9).when(k == "landing", 1).otherwise(0).alias("landing"), u.alias("url"),
    )


def profile(source: Column, url: Column) -> Column:
    """The kind of host that a location belongs to."""
    s, h, p = F.lower(blank(source)), host(url), F.lower(path(url))
    return (
        F.when(F.contains(s, F.lit("arxiv")) | h.endswith("arxiv.org"), "arxiv")
        .when((s == "pmc_oai") | h.endswith("pmc.ncbi.nlm.nih.gov") | (h.endswith("europepmc.org") & F.contains(p, F.lit("/article/")) & F.contains(p, F.lit("pmc"))), "pmc")
        .when(h.endswith("iopscience.iop.org") & p.startswith("/article/"), "iop")
        .when(s.isin("core", "openaire", "doaj", "datacite", "unpaywall"), "repository")
        .otherwise("generic")
    )


def link_kind(url: Column, content_type: Column) -> Column:
    """pdf, html, xml or landing, by content type and suffix."""
    t, u = F.lower(blank(content_type)), F.lower(F.substring_index(blank(url), "?", 1))
    has = lambda *words: F.lit(False) if not words else (F.contains(t, F.lit(words[0])) | has(*words[1:]))
    return (
        F.when(has("pdf") | u.endswith(".pdf"), "pdf").when(has("html") | u.rlike(r"\.html?$"), "html")
        .when(has("xml", "jats") | u.rlike(r"\.(xml|jats)$"), "xml").otherwise("landing")
    )


def redacted(url: Column) -> Column:
    """The URL for logs: the query as a mark, no fragment and no user information."""
    authority = F.regexp_replace(part(url, 2), "^.*@", "")
    query = F.when(part(url, 4) == "", "").otherwise("?[redacted]")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), authority, part(url, 3), query)


def source_filename(source: Column, url: Column, index: Column, suffix: str = "html") -> Column:
    """Index, source, host and a digest of the URL as a file name."""
    from .text import safe_part

    authority = F.coalesce(F.nullif(part(url, 2), F.lit("")), F.lit("url"))
    return F.concat_ws(".", F.lpad(index.cast("string"), 2, "0"), safe_part(F.coalesce(F.nullif(source, F.lit("")), F.lit("source"))), safe_part(authority), F.substring(F.sha1(blank(url)), 1, 10), F.lit(suffix))


def looks_like_pdf_download(url: Column) -> Column:
    """Whether a URL downloads a PDF, by file name, path or query."""
    way = F.lower(F.coalesce(F.try_url_decode(part(url, 3)), part(url, 3)))
    query = F.lower(part(url, 4))
    return way.endswith(".pdf") | F.contains(way, F.lit("download")) | query.rlike("(^|&)format=pdf(&|$)") | query.rlike("(^|&)response-content-disposition=[^&]*attachment")


def asset_filename(index: Column, url: Column, content_type: Column) -> Column:
    """A file name for a page's asset: its place, a digest of its URL, and a suffix by path or media type."""
    from .media_types import suffix_for

    own = F.lower(F.regexp_extract(path(url), r"[^/.][^/]*(\.[^./]*)$", 1))
    suffix = F.when((F.length(own) > 1) & (F.length(own) <= 8), own).otherwise(suffix_for(content_type))
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("."), F.substring(F.sha1(blank(url)), 1, 12), F.coalesce(F.nullif(suffix, F.lit("")), F.lit(".bin")))

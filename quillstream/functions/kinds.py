"""What kind of page a stored document is: an ordered list of tests over its text and its URL.

The tests look at the first half million characters, and at the whole page only where none of them holds
there, so that marks near the head decide before marks in quoted material far below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank
from .urls import host, part

SAMPLE = 500_000

# Hosts, and marks in lower-cased pages.
SCIENDO = ("content.sciendo.com", "reference-global.com", "www.reference-global.com")
PMC = ("pmc.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov")
SPRINGER = ("link.springer.com", "www.nature.com")
IOP_PUBLISHER = ("citation_publisher\" content=\"iop publishing", "citation_publisher' content='iop publishing")
IOP_FULL_TEXT = ("wd-jnl-art-full-text", "itemprop=\"articlebody\"", "itemprop='articlebody'", "class=\"article-content\"", "class='article-content'")
ABSTRACT_KINDS = ("arxiv_abs_page", "sciendo_abstract_page", "ojs_abstract_page")


def _has(text: Column, *marks: str) -> Column:
    """Whether any of the marks stands in a text."""
    found = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        found = found | F.contains(text, F.lit(m))
    return found


def _rules(low: Column, at: Column, path: Column) -> list[tuple[str, Column]]:
    """Kinds and their tests, in order; `at` is the host."""
    sciendo = at.isin(*SCIENDO) | _has(low, *SCIENDO[:2])
    journal_system = at.endswith("almclinmed.ru") | _has(low, "almclinmed.ru", "open journal systems", "pkp")
    iop_text = _has(low, *IOP_FULL_TEXT)
    iop_url = at.endswith("iopscience.iop.org") & path.startswith("/article/")
    iop_part = path.rlike("/(meta|pdf|xml)$")
    return [
        ("arxiv_abs_page", _has(low, 'name="citation_arxiv_id"') & _has(low, "html (experimental)", "latexml-download-link") & _has(low, "abs-button", "extra-services")),
        ("generic_article", sciendo & _has(low, "article-content") & _has(low, "full article", "tab-button-article")),
        ("sciendo_abstract_page", sciendo & _has(low, "content-tabs") & _has(low, "tab-button-article") & ~_has(low, "article-content") & _has(low, "abstract-content", "self.__next_f.push")),
        ("ojs_abstract_page", journal_system & _has(low, 'id="articlefulltext"') & _has(low, 'id="articleabstract"') & _has(low, "citation_pdf_url", "/article/download/", 'class="file"')),
        ("arxiv_latexml", _has(low, "ltx_page_main") & ((_has(low, "generated") & _has(low, "latexml")) | _has(low, "ltx_bibliography", "ltx_title_document") | (at.endswith("arxiv.org") & path.rlike(r"^/html/\d{4}\.\d{4,5}(v\d+)?/?$")))),
        ("pmc_article", at.isin(*PMC) | _has(low, "pmc-article") | (_has(low, 'id="main-content"') & _has(low, "pmc"))),
        ("taylor_francis_article", at.endswith("tandfonline.com") | _has(low, "hlfld-fulltext", "nlm_article")),
        ("springer_nature_article", at.isin(*SPRINGER) | _has(low, "c-article-body", "article__body")),
        ("iop_article", (iop_url & (~iop_part | iop_text)) | (~iop_url & _has(low, *IOP_PUBLISHER, "iopscience.iop.org/article/") & iop_text)),
        ("researchgate_page", at.endswith("researchgate.net") | _has(low, "www.researchgate.net", "lite.publicationdetails", "research-detail-header-section") | (_has(low, "download full-text pdf") & _has(low, "researchgate"))),
    ]


def _first(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for kind, test in reversed(rules):
        out = F.when(test, kind).otherwise(out)
    return out


def page_kind(page: Column, url: Column) -> Column:
    """The kind of a page; null and empty pages are unknown."""
    at, path = host(url), F.lower(part(url, 3))

    def kind(low: Column) -> Column:
        head = F.substring(low, 1, SAMPLE)
        whole = F.when(F.length(low) > SAMPLE, _first(_rules(low, at, path)))
        return F.coalesce(_first(_rules(head, at, path)), whole, F.when(_has(head, "<article"), "generic_article"), F.lit("unknown"))

    # The lower-cased page is an array of one, so it is computed once for all tests.
    by_marks = F.get(F.transform(F.array(F.lower(blank(page))), kind), F.lit(0))
    preprint = at.endswith("arxiv.org") & path.rlike(r"^/abs/\d{4}\.\d{4,5}(v\d+)?/?$")
    return F.when(preprint, "arxiv_abs_page").otherwise(by_marks)


def is_shell(page: Column, text_chars: Column) -> Column:
    """Whether a page of a sharing site only offers a download: no article element and little text."""
    low = F.substring(F.lower(blank(page)), 1, SAMPLE)
    return ~_has(low, "<article", "article-content", "article__content") & (text_chars < 3000) & _has(low, "download full-text pdf", "request full-text", "research-detail-header-section", "lite.publicationdetails")

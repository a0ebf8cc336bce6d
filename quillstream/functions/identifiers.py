"""Scholarly identifiers: extraction from free text and normal forms, as native columns.

Extractors return null where nothing is found; normal forms return an empty string for nonsense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, none_if_blank, unescape

# Patterns of the identifiers.
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
_ARXIV_ID = r"((?:[A-Za-z.-]+/\d{7}|\d{4}\.\d{4,5}))(?:v\d+)?"
ARXIV = (rf"(?i)\b10\.48550/arxiv\.{_ARXIV_ID}\b", rf"(?i)\barxiv\s*:\s*{_ARXIV_ID}\b", rf"(?i)\barxiv\.org/(?:abs|pdf|html)/{_ARXIV_ID}(?:\.pdf)?")
PMID = (
    r"(?i)\bPMID\s*[:#]?\s*(\d{5,10})\b", r"(?i)\bpubmed(?:\s+id)?\s*[:#]?\s*(\d{5,10})\b",
    r"(?i)\bpubmed\.ncbi\.nlm\.nih\.gov/(\d{5,10})\b", r"(?i)\bncbi\.nlm\.nih\.gov/pubmed/(\d{5,10})\b",
)
PMCID = (r"(?i)\bPMC(\d{5,10})\b",)
ISBN = r"(?i)\bISBN(?:-1[03])?\s*[:#]?\s*((?:97[89][-\s]?)?[0-9][0-9Xx\-\s]{8,20}[0-9Xx])\b"
TRAILING = r"[.,;:)\]}]+$"


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches, in the patterns' order."""
    return F.coalesce(*[none_if_blank(F.regexp_extract(blank(text), p, 1)) for p in patterns])


def _cut(value: Column, *prefixes: str) -> Column:
    out = F.trim(unescape(blank(value)))
    for prefix in prefixes:
        out = F.regexp_replace(out, prefix, "")
    return F.regexp_replace(F.trim(out), TRAILING, "")


def normalize_doi(value: Column) -> Column:
    return _cut(value, r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)")


def extract_doi(text: Column) -> Column:
    return none_if_blank(normalize_doi(F.regexp_extract(blank(text), DOI, 1)))


def normalize_arxiv_id(value: Column) -> Column:
    out = _cut(value, r"(?i)^arxiv:\s*", r"(?i)^https?://arxiv\.org/(?:abs|pdf|html)/", r"(?i)^10\.48550/arxiv\.")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\.pdf$", ""), r"(?i)v\d+$", "")


def extract_arxiv_id(text: Column) -> Column:
    return none_if_blank(normalize_arxiv_id(_first(text, ARXIV)))


def normalize_pmid(value: Column) -> Column:
    digits = F.regexp_extract(_cut(value, r"(?i)^PMID\s*[:#]?\s*", r"(?i)^pubmed(?:\s+id)?\s*[:#]?\s*"), r"(\d{1,10})", 1)
    return F.regexp_replace(digits, "^0+", "")


def extract_pmid(text: Column) -> Column:
    return none_if_blank(normalize_pmid(_first(text, PMID)))


def normalize_pmcid(value: Column) -> Column:
    digits = F.regexp_extract(unescape(blank(value)), r"(?i)PMC\s*(\d{5,10})", 1)
    return F.when(digits == "", F.lit("")).otherwise(F.concat(F.lit("PMC"), digits))


def extract_pmcid(text: Column) -> Column:
    found = _first(text, PMCID)
    return F.when(found.isNotNull(), F.concat(F.lit("PMC"), found))


def normalize_isbn(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(unescape(blank(value))), r"(?i)^ISBN(?:-1[03])?\s*[:#]?\s*", "")
    kept = F.regexp_replace(bare, "[^0-9Xx]", "")
    # Only the check character at the end is put in upper case.
    upper = F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), F.upper(F.substring(kept, -1, 1)))
    return F.when(F.length(kept).isin(10, 13), upper).otherwise("")


def extract_isbn(text: Column) -> Column:
    return none_if_blank(normalize_isbn(F.regexp_extract(blank(text), ISBN, 1)))


def extract_all(text: Column) -> Column:
    """All identifiers of a text as a struct."""
    return F.struct(
        extract_doi(text).alias("doi"), extract_arxiv_id(text).alias("arxiv_id"), extract_pmid(text).alias("pmid"),
        extract_pmcid(text).alias("pmcid"), extract_isbn(text).alias("isbn"),
    )


def ordered_candidates(text: Column, most: int = 16) -> Column:
    """Typed identifiers of a text in the order doi, arxiv, pmid, pmcid, isbn, at most `most`."""
    pairs = [("doi", extract_doi(text)), ("arxiv", extract_arxiv_id(text)), ("pmid", extract_pmid(text)), ("pmcid", extract_pmcid(text)), ("isbn", extract_isbn(text))]
    typed = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in pairs])
    return F.slice(F.array_compact(typed), 1, most)


def doi_url(url: Column, doi: Column) -> Column:
    """The URL if it is http or https, else the DOI's URL, else null."""
    clean = F.trim(blank(url))
    normal = normalize_doi(doi)
    return F.when(F.lower(clean).rlike("^https?://"), clean).when(normal != "", F.concat(F.lit("https://doi.org/"), normal))

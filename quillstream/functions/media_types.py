"""What an attachment is, by media type and file name; the media type wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

# Media types and suffixes.
HTML_TYPES = ("text/html", "application/xhtml+xml", "multipart/related", "message/rfc822")
PDF_TYPES = ("application/pdf", "application/x-pdf")
HTML_SUFFIX = r"\.(html|htm|mhtml|mht)$"
PDF_SUFFIX = r"\.pdf$"
#: Languages in a file name's marker that do not mean source HTML.
NOT_LANGUAGES = ("ru", "source", "arxiv", "ocr", "fulltext", "pdf", "html")
SUFFIX_OF_TYPE = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "text/css": ".css", "font/woff": ".woff", "font/woff2": ".woff2", "application/font-woff": ".woff"}


def base_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(blank(content_type), ";", 1)))


def has_suffix(path: Column, pattern: str) -> Column:
    """Whether the file name ends so, without storage prefix, query, fragment and closing slashes."""
    bare = F.regexp_replace(F.trim(blank(path)), "^storage:", "")
    bare = F.regexp_replace(F.substring_index(F.substring_index(bare, "?", 1), "#", 1), "/+$", "")
    name = F.substring_index(bare, "/", -1)
    return F.lower(name).rlike("[^.]" + pattern)  # a bare ".pdf" is a name, not a suffix


def is_pdf(content_type: Column, path: Column, file_path: Column) -> Column:
    mime = base_type(content_type)
    return F.when(mime.isin(*HTML_TYPES), False).when(mime.isin(*PDF_TYPES), True).otherwise(has_suffix(path, PDF_SUFFIX) | has_suffix(file_path, PDF_SUFFIX))


def is_html(content_type: Column, path: Column, file_path: Column) -> Column:
    mime = base_type(content_type)
    return F.when(mime.isin(*PDF_TYPES), False).otherwise(mime.isin(*HTML_TYPES) | has_suffix(path, HTML_SUFFIX) | has_suffix(file_path, HTML_SUFFIX))


def marker(name: Column) -> Column:
    """The language in a `[xx html]` marker of a file name, in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(blank(name)), r"\[([a-z][a-z_-]*) html\]", 1)


def is_source_html(name: Column) -> Column:
    m = marker(name)
    return (m == "source") | ((m != "") & ~m.isin(*NOT_LANGUAGES))


def is_generated_html(name: Column) -> Column:
    return F.lower(blank(name)).rlike(r"\[[a-z]{2}(-[a-z]+)? html\]\.html?$")


def suffix_for(content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_OF_TYPE.items() for x in pair])
    return F.coalesce(F.element_at(table, base_type(content_type)), F.lit(""))

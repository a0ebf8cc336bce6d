"""What may be fetched, what may be tried again, and names that file systems accept."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import urls
from .text import blank, collapse, normalize_space, title_match_score, token_hits_suffice

# Schemes, hosts and statuses.
BLOCKED_SCHEMES = ("file", "ftp", "gopher", "javascript", "data", "mailto")
BLOCKED_HOSTS = ("localhost", "localhost.localdomain")
RETRIED_CODES = (408, 409, 425, 429, 500, 502, 503, 504)
BROWSER_FINAL = (
    "attach_invalid_result", "download_invalid_result", "download_not_pdf", "item_key_required_for_attach", "item_not_found", "network_policy_blocked", "parent_already_has_pdf",
    "playwright_missing", "preflight_invalid_result", "unsafe_browser_url",
)
PDF_FINAL = (
    "attach_invalid_result", "download_artifact_changed", "download_invalid_result", "identity_invalid_result", "identity_mismatch", "item_not_found", "missing_doi", "missing_query", "non_pdf",
    "parent_already_has_pdf", "too_large", "unresolved", "unsafe_url",
)
RESERVED_NAMES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def ip_class(address: str) -> str:
    """loopback, special, private or global; empty if it is no address."""
    try:
        ip = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return ""
    if ip.is_loopback:
        return "loopback"
    if ip.is_link_local or ip.is_multicast or ip.is_unspecified or ip.is_reserved:
        return "special"
    return "private" if ip.is_private else "global" if ip.is_global else "special"


@pandas_udf(T.StringType())
def _ip_classes(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda h: ip_class(h or ""))


def url_verdict(url: Column, allow_private: bool = False) -> Column:
    """ok, or the first reason why a URL must not be fetched.

    Only hosts that look like addresses are classified in Python.
    """
    scheme, authority = F.lower(urls.part(url, 1)), F.lower(F.regexp_replace(urls.part(url, 2), "^.*@", ""))
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(authority, ":", 1))
    kind = F.when(host.rlike(r"^[0-9.]+$|:"), _ip_classes(host)).otherwise("")
    bad = kind.isin("loopback", "special", *(() if allow_private else ("private",)))
    return (
        F.when(F.trim(blank(url)) == "", "empty_url").when(scheme.isin(*BLOCKED_SCHEMES), "blocked_scheme").when(~scheme.isin("http", "https"), "unsupported_scheme").when(host == "", "missing_host")
        .when(host.isin(*BLOCKED_HOSTS) | host.endswith(".localhost"), "blocked_host").when(bad, "blocked_ip").otherwise("ok")
    )


def request_decision(url: Column, origin: Column, navigation: Column, own_domain: str) -> Column:
    """A browser policy as a ladder: the first rule against a request, or the category that lets it through."""
    host, port, scheme = urls.host(url), F.regexp_extract(urls.part(url, 2), r":(\d+)$", 1), F.lower(urls.part(url, 1))
    own = (host == own_domain) | host.endswith("." + own_domain)
    safe = url_verdict(url)
    return (
        F.when(scheme != "https", "https_required").when(F.contains(urls.part(url, 2), F.lit("@")), "credentials_forbidden").when(~port.isin("", "443"), "nonstandard_port").when(host == "", "missing_host")
        .when(safe != "ok", safe).when(navigation & ~own & (host != urls.host(origin)), "cross_host_navigation_blocked").when(navigation, "navigation").when(own, "own_subresource").otherwise("external_subresource")
    )


def skips_asset(url: Column) -> Column:
    low = F.lower(F.trim(blank(url)))
    return (low == "") | low.rlike(r"^(data:|javascript:|mailto:|#)") | low.endswith(".pdf")


def asset_rank(url: Column) -> Column:
    """Order in which assets are fetched: figures, images, styles, others, icons."""
    p = F.lower(urls.path(url))
    image = p.rlike(r"\.(jpe?g|png|webp|gif)$")
    return F.when(image & p.rlike("/blobs/|fig|image"), 0).when(image, 1).when(p.endswith(".css"), 2).when(p.endswith(".svg") | p.rlike("icon|logo"), 4).otherwise(3)


def wanted_image(url: Column, attrs: Column) -> Column:
    """Whether an image belongs to the article: no icons, logos, trackers or adverts, not tiny."""
    probe = F.lower(F.concat_ws(" ", urls.path(url), urls.part(url, 4), F.element_at(attrs, "class"), F.element_at(attrs, "id"), F.element_at(attrs, "alt")))
    size = lambda k: F.coalesce(F.regexp_extract(blank(F.element_at(attrs, k)), r"^(\d+)", 1).try_cast("int"), F.lit(1 << 20))
    furniture = probe.rlike(r"(^|[^a-z])(icon|logo|sprite|avatar|badge|banner|advert|ads?|pixel|tracking|spacer|button|social|orcid)([^a-z]|$)")
    return ~skips_asset(url) & ~furniture & (F.least(size("width"), size("height")) > 32)


def is_pdf_response(final_url: Column, content_type: Column, body: Column) -> Column:
    from .media_types import PDF_TYPES, base_type

    return base_type(content_type).isin(*PDF_TYPES) | (F.substring(body, 1, 4) == F.lit(b"%PDF"))


def pdf_identity(title: Column, text: Column, least_chars: int = 80, least_score: float = 0.70) -> Column:
    """Whether the text of a PDF's first pages is that of a title, or why not; a null text has no text layer."""
    tokens = F.slice(F.filter(F.split(F.lower(normalize_space(title)), " "), lambda t: (F.length(t) >= 5) & t.rlike(r"^\p{ASCII}+$")), 1, 8)
    hits = (F.size(tokens) > 0) & token_hits_suffice(tokens, F.lower(text))
    return (
        F.when(blank(title) == "", "no_expected_title").when(text.isNull(), "pdf_text_unavailable").when(F.length(F.trim(text)) < least_chars, "no_text_layer")
        .when((title_match_score(title, F.substring(text, 1, 4000)) < least_score) & ~hits, "title_mismatch").otherwise("title_match")
    )


def is_final_error(message: Column, marks: Sequence[str]) -> Column:
    """Errors that no retry mends, by the marks of a configuration's errors."""
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(blank(message), F.lit(mark))
    return found


def browser_retryable(status: Column) -> Column:
    return ~F.trim(blank(status)).isin(*BROWSER_FINAL)


def pdf_retryable(status: Column, code: Column) -> Column:
    s = F.trim(blank(status))
    return F.when(s.isin(*PDF_FINAL), False).when(s == "http_error", code.isNull() | code.isin(*RETRIED_CODES)).otherwise(True)


def blocked_reason(code: Column, body: Column) -> Column:
    """Why a provider's answer calls for no action; null if it does."""
    return F.when((code == 403) & F.lower(blank(body)).rlike("cloudflare|just a moment"), "metadata_provider_blocked")


def payload_status(accepted_html: Column, rejected_html: Column, pdfs: Column, needs_ocr: Column, existing: Column, browser: Column, status: Column) -> Column:
    """One status for what a full-text search found, over counts and flags."""
    html, pdf = accepted_html > 0, pdfs > 0
    return (
        F.when(html & pdf & needs_ocr, "html_and_pdf_found_needs_ocr").when(html & pdf, "html_and_pdf_found").when(html, "html_found").when(pdf & needs_ocr, "pdf_found_needs_ocr").when(pdf, "pdf_found")
        .when(blank(existing) != "", existing).when(browser > 0, "browser_pdf_fallback_available").when(rejected_html > 0, "html_rejected").otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("unresolved")))
    )


def quoted(value: Column) -> Column:
    """Percent-encoded in full; a space is %20."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(value), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def bounded_query(candidates: Column, most_bytes: int = 1800, most: int = 16) -> Column:
    """Typed identifiers as `kind:value` pairs joined by commas: greedily those that fit the byte budget.

    A pair that does not fit is passed over, later and shorter ones may still fit; pairs repeat but for case
    only once.
    """
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("bytes"))

    def add(acc: Column, c: Column) -> Column:
        pair = F.concat(quoted(c["kind"]), F.lit(":"), quoted(c["value"]))
        key = F.lower(F.concat(c["kind"], F.lit("\0"), c["value"]))
        size = F.octet_length(pair) + F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        fits = (F.size(acc["kept"]) < most) & (blank(c["value"]) != "") & ~F.array_contains(acc["seen"], key) & (acc["bytes"] + size <= most_bytes)
        grown = F.struct(F.array_append(acc["kept"], pair).alias("kept"), F.array_append(acc["seen"], key).alias("seen"), (acc["bytes"] + size).alias("bytes"))
        return F.when(fits, grown).otherwise(acc)

    return F.aggregate(candidates, start, add, lambda acc: F.array_join(acc["kept"], ","))


def safe_filename(value: Column, default: str = "document", most: int = 120) -> Column:
    """A file name that every file system takes."""
    clean = F.regexp_replace(collapse(F.regexp_replace(blank(value), r"[\x00-\x1f<>:\"/\\|?*]+", " ")), "[ .]+$", "")
    cut = F.regexp_replace(F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit(default)), 1, most), "[ .]+$", "")
    return F.when(cut.rlike(RESERVED_NAMES), F.substring(F.concat(F.lit("_"), cut), 1, most)).otherwise(F.coalesce(F.nullif(cut, F.lit("")), F.lit("_")))


def retry_seconds(value: Column, now: Column) -> Column:
    """Seconds until a Retry-After header's number or HTTP date, 0 at least; null for anything else."""
    text = F.trim(blank(value))
    date = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    seconds = F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))

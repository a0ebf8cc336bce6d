"""Features of HTML pages and the verdict on whether one is a whole article, as native columns.

The verdict is an ordered ladder: the first reason that holds is the answer.  Features are computed once
as columns, so each page is scanned by each pattern once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, normalize_space, strip_html, unescape

# Marker names with their patterns, over lower-cased HTML or text.
ARTICLE_MARKERS = (
    ("article_tag", r"<article\b"), ("citation_title", "name=[\"']citation_title[\"']"), ("og_article", "property=[\"']og:type[\"'][^>]+article"),
    ("schema_article", r"@type[^\n]{0,120}article"), ("abstract", r"\babstract\b"), ("references", r"\breferences\b"), ("figures", r"\bfigures?\b"),
    ("fulltext", "full[- ]?text"), ("article_body", "article[-_ ]?(body|content|section)"), ("pmc_article", "pmc-article"),
    ("arxiv_ltx_document", r"\bltx_document\b"), ("arxiv_ltx_abstract", r"\bltx_abstract\b"), ("arxiv_ltx_bibliography", r"\bltx_bibliography\b"),
    ("arxiv_html", "arxiv[^\"'>]{0,40}html"),
)
#: What a text must hold for a marker's pattern to fit: a plain search that passes over most patterns.
NEEDLES = {
    "article_tag": "<article", "citation_title": "citation_title", "og_article": "og:type", "schema_article": "@type", "fulltext": "full", "figures": "figure", "article_body": "article", "pmc_article": "pmc-article",
    "arxiv_ltx_document": "ltx_document", "arxiv_ltx_abstract": "ltx_abstract", "arxiv_ltx_bibliography": "ltx_bibliography", "arxiv_html": "arxiv", "methods": "methods", "results": "results", "discussion": "discussion",
    "conclusion": "conclusion", "abstract": "abstract", "references": "references",
}
SECTION_MARKERS = (
    ("abstract", r"\babstract\b"), ("methods", r"\b(methods|materials and methods)\b"), ("results", r"\bresults\b"),
    ("discussion", r"\bdiscussion\b"), ("conclusion", r"\bconclusions?\b"), ("references", r"\breferences\b"),
)
CHALLENGES = ("client challenge", "checking your browser", "recaptcha", "captcha", "cloudflare", "access denied", "just a moment", "enable javascript", "are you a human")
PREVIEW = "this is a preview of subscription content"
CHAPTER = ("buy chapter", "subscribe and save", "institutional subscriptions", "log in via an institution")
ACCESS_TITLES = ("get access", "purchase access", "rent this article", "login", "log in", "subscribe", "institutional access")
STRONG = ("article_tag", "article_body", "pmc_article", "schema_article")
LEAST_CHARS = {"arxiv": 4000, "pmc": 5000, "iop": 5000}
LEAST_CHARS_ELSE = 8000


def page_title(page: Column) -> Column:
    """Text of the first title element."""
    return strip_html(F.regexp_extract(blank(page), r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(page: Column) -> Column:
    """Text outside tags, scripts, styles and comments."""
    bare = F.regexp_replace(blank(page), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return strip_html(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "))


def without_payloads(page: Column) -> Column:
    """The page without comments, scripts, styles, noscript and template elements."""
    bare = F.regexp_replace(blank(page), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", "")


def markers(text: Column, table: tuple[tuple[str, str], ...], lowered: bool = False) -> Column:
    """Names of the patterns that a text shows, in the table's order; `lowered` texts are in lower case already."""
    low = text if lowered else F.lower(blank(text))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(NEEDLES[name])) & low.rlike(pattern), F.lit(name)) for name, pattern in table]))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words (plain letters and spaces) stands in a text: one pass for all."""
    return text.rlike("|".join(words))


def is_challenge(title: Column, text: Column) -> Column:
    return _any(F.lower(F.concat_ws("\n", title, F.substring(text, 1, 5000))), CHALLENGES)


def is_preview(title: Column, text: Column, lowered: bool = False) -> Column:
    """Whether a page only previews its article; `lowered` texts are in lower case already."""
    whole = (F.lower(title), text) if lowered else (F.lower(title), F.lower(text))
    has = lambda mark: F.contains(whole[0], F.lit(mark)) | F.contains(whole[1], F.lit(mark))
    offered = has(CHAPTER[0])
    for mark in CHAPTER[1:]:
        offered = offered | has(mark)
    return has(PREVIEW) | (has("access this chapter") & offered)


def is_access_title(title: Column) -> Column:
    return _any(F.lower(blank(title)), ACCESS_TITLES)


def looks_like_html(body: Column) -> Column:
    head = F.lower(F.ltrim(F.substring(blank(body), 1, 4096)))
    return head.startswith("<!doctype html") | head.startswith("<html") | F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<body"))


def least_chars(profile: Column) -> Column:
    out = F.lit(LEAST_CHARS_ELSE)
    for name, chars in LEAST_CHARS.items():
        out = F.when(profile == name, chars).otherwise(out)
    return out


def has_structure(found: Column, profile: Column) -> Column:
    strong = F.arrays_overlap(found, F.array(*map(F.lit, STRONG)))
    return strong | ((profile == "arxiv") & F.array_contains(found, "arxiv_ltx_document"))


def has_body(found: Column, sections: Column, profile: Column) -> Column:
    latex = (profile == "arxiv") & F.array_contains(found, "arxiv_ltx_abstract") & F.array_contains(found, "arxiv_ltx_bibliography")
    refs = F.array_contains(found, "references") | F.array_contains(sections, "references")
    parts = F.array(*map(F.lit, ("methods", "results", "discussion", "conclusion")))
    return latex | refs | (F.size(F.array_intersect(sections, parts)) >= 2)


def with_features(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add title, text, text_chars, markers, section_markers, challenge, preview, image_count and link_count."""
    # Each step is a projection of its own: lower-casing and tag stripping run once for all patterns.
    out = pages.withColumns({"_low": F.lower(blank(F.col(html_col))), "title": page_title(F.col(html_col)), "text": visible_text(F.col(html_col))})
    out = out.withColumn("_low_text", F.lower("text"))
    low = F.col("_low")
    return out.withColumns(
        {
            "text_chars": F.length("text").cast("long"), "markers": markers(low, ARTICLE_MARKERS, True), "section_markers": markers(F.col("_low_text"), SECTION_MARKERS, True),
            "challenge": is_challenge(F.col("title"), F.col("text")), "preview": is_preview(F.col("title"), F.col("_low_text"), True),
            "image_count": F.regexp_count(low, F.lit(r"<img\b")).cast("long"), "link_count": F.regexp_count(low, F.lit(r"\bhref\s*=")).cast("long"),
        }
    ).drop("_low", "_low_text")


def article_reason(title_ok: Column, profile: Column, least: Column | None = None) -> Column:
    """The verdict over the columns of `with_features`: article_html, or the first reason against it."""
    found, sections = F.col("markers"), F.col("section_markers")
    return (
        F.when(F.col("challenge"), "challenge_page").when(F.col("preview"), "limited_access_preview").when(~title_ok, "title_mismatch")
        .when(F.col("text_chars") < (least_chars(profile) if least is None else least), "short_text").when(~has_structure(found, profile), "article_structure_missing")
        .when(~has_body(found, sections, profile), "article_body_missing").otherwise("article_html")
    )


def attribute_values(page: Column, tag: str, attribute: str) -> Column:
    """All values of an attribute of an element, in page order."""
    return F.regexp_extract_all(blank(page), F.lit(rf"(?is)<{tag}\b[^>]*?(?<![\w:-]){attribute}\s*=\s*([\"'])(.*?)\1"), F.lit(2))


# Elements whose attribute names a resource.
RESOURCES = (("img", "src"), ("source", "src"), ("link", "href"), ("script", "src"), ("image", "href"), ("image", "xlink:href"), ("use", "href"), ("use", "xlink:href"))


def resource_refs(page: Column) -> Column:
    """Resources that a page names, in the order of the elements' kinds, the URLs of source sets behind them."""
    plain = F.concat(*[attribute_values(page, t, a) for t, a in RESOURCES])
    sets = F.concat(attribute_values(page, "img", "srcset"), attribute_values(page, "source", "srcset"))
    return F.concat(plain, F.flatten(F.transform(sets, srcset_urls)))


def is_remote(ref: Column) -> Column:
    return F.lower(ref).rlike("^(https?:)?//")


def is_local(ref: Column) -> Column:
    """Whether a reference names a file beside the page."""
    return (ref != "") & ~F.lower(ref).rlike("^(https?://|//|data:|javascript:|mailto:|#)")


def local_path(ref: Column) -> Column:
    """The file that a local reference names; null for paths that leave the page's folder."""
    bare = F.substring_index(F.substring_index(ref, "?", 1), "#", 1)
    return F.when((bare != "") & (F.length(bare) <= 4096) & ~bare.startswith("/") & ~bare.rlike(r"(^|/)\.\.(/|$)"), F.regexp_replace(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), r"^(\./)+", ""))


def missing_local(refs: Column, files: Column) -> Column:
    """Local references whose file is not among `files` (paths below the page's folder)."""
    return F.filter(refs, lambda r: is_local(r) & ~F.coalesce(F.array_contains(files, local_path(r)), F.lit(False)))


def anchors(page: Column) -> Column:
    """Distinct ids and names that fragments can point to."""
    return F.array_distinct(F.regexp_extract_all(blank(page), F.lit(r"(?is)<[a-z][^>]*?\s(?:id|name)\s*=\s*([\"'])(.*?)\1"), F.lit(2)))


def fragment_links(page: Column) -> Column:
    """Distinct fragments that links of a page point to."""
    hrefs = F.transform(F.filter(attribute_values(page, "a", "href"), lambda h: h.startswith("#") & (F.length(h) > 1)), lambda h: F.substring(h, 2, 1 << 30))
    return F.array_distinct(hrefs)


def css_urls(css: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(blank(css), F.lit(r"(?i)url\(\s*([\"']?)(.*?)\1\s*\)"), F.lit(2)), lambda x: F.trim(x)))


def css_imports(css: Column) -> Column:
    return F.regexp_extract_all(blank(css), F.lit(r"(?i)@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)"), F.lit(1))


def srcset_urls(value: Column) -> Column:
    """URLs of a source set: the first word of each part between a comma and white space."""
    parts = F.transform(F.split(F.trim(unescape(blank(value))), r",\s+"), lambda p: F.regexp_extract(p, r"^\s*(\S+)", 1))
    return F.filter(parts, lambda p: p != "")


def unsafe_attributes(page: Column) -> Column:
    """How many event handlers and script URLs stand inside tags."""
    tags = F.regexp_extract_all(blank(page), F.lit(r"(?s)(<[a-zA-Z][^>]*>)"), F.lit(1))
    pattern = F.lit(r"(?i)\son[a-z]+\s*=|(?:href|src)\s*=\s*[\"']?\s*javascript:")
    return F.aggregate(F.transform(tags, lambda t: F.regexp_count(t, pattern)), F.lit(0), lambda a, b: a + b).cast("long")


def math_strategy(page: Column) -> Column:
    low = F.lower(blank(page))
    return F.struct(F.contains(low, F.lit("<math")).alias("mathml"), F.contains(low, F.lit("katex")).alias("katex"), F.contains(low, F.lit("mathjax")).alias("mathjax"), F.regexp_count(low, F.lit(r"<img\b[^>]*(formula|equation|math)")).cast("long").alias("formula_images"))


def document_title(page: Column) -> Column:
    """The citation or social title of a page, else its title element."""
    meta = lambda key: F.regexp_extract(blank(page), rf"(?is)<meta\b[^>]*(?:name|property)\s*=\s*[\"']{key}[\"'][^>]*content\s*=\s*[\"'](.*?)[\"']", 1)
    return F.coalesce(*[F.nullif(normalize_space(c), F.lit("")) for c in (meta("citation_title"), meta("og:title"), page_title(page))], F.lit(""))


def meta_values(page: Column, name: str) -> Column:
    """Contents of the meta elements of a name (or property), in page order, blank ones left out."""
    tags = F.regexp_extract_all(blank(page), F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))
    own = F.filter(tags, lambda t: F.lower(t).rlike(rf"(?s)(?:^|\s)(?:name|property)\s*=\s*[\"']?\s*{name}\s*(?:[\"'\s/]|$)"))
    contents = F.transform(own, lambda t: F.trim(unescape(F.coalesce(F.regexp_extract(t, r"(?is)(?:^|\s)content\s*=\s*([\"'])(.*?)\1", 2), F.lit("")))))
    return F.filter(contents, lambda v: v != "")


def absolute(base: Column, ref: Column) -> Column:
    """A reference on a base URL, for references that are absolute, start at the scheme or root, or are a plain path."""
    from . import urls

    scheme, authority = F.lower(urls.part(base, 1)), urls.part(base, 2)
    folder = F.regexp_replace(urls.part(base, 3), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), authority)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref)).when(ref.startswith("/"), F.concat(root, ref))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(ref, r"^(\./)+", "")))
    )


def citation_pdf_urls(page: Column, base: Column) -> Column:
    """All PDF URLs that a page's citation fields name, on its base, without supplements and repeats."""
    from . import urls

    found = F.array_distinct(F.transform(meta_values(page, "citation_pdf_url"), lambda u: absolute(base, u)))
    return F.filter(found, lambda u: ~urls.is_supplement_url(u))


def iop_pdf_url(url: Column) -> Column:
    """The PDF of an article page of one publisher whose PDFs stand below it; empty for other URLs."""
    from . import urls

    path = F.regexp_replace(urls.part(url, 3), "/+$", "")
    fits = urls.host(url).endswith("iopscience.iop.org") & F.lower(path).startswith("/article/") & ~F.lower(path).endswith("/pdf")
    return F.when(fits, F.concat(F.lower(urls.part(url, 1)), F.lit("://"), urls.part(url, 2), path, F.lit("/pdf"))).otherwise("")


def derived_pdfs(page: Column, base: Column) -> Column:
    """PDF locations that a page lets derive (url, derivation), the first of each URL."""
    from . import urls

    cited = F.transform(citation_pdf_urls(page, base), lambda u: F.struct(u.alias("url"), F.lit("citation_pdf_url").alias("derivation")))
    own = iop_pdf_url(base)
    rows = F.concat(cited, F.when(own != "", F.array(F.struct(own.alias("url"), F.lit("iop_article_pdf").alias("derivation")))).otherwise(F.array().cast("array<struct<url:string,derivation:string>>")))
    keys = F.transform(rows, lambda r: urls.normalized_probe_url(r["url"]))
    return F.filter(rows, lambda r, i: F.array_position(keys, urls.normalized_probe_url(r["url"])) == i + 1)


def canonical_article_url(page: Column, base: Column) -> Column:
    """The full article behind an abstract page of one publisher, by its URL or by a link; empty for other pages."""
    from . import urls

    path, at = urls.part(base, 3), urls.host(base).endswith("thieme-connect.de")
    root = F.concat(F.lower(urls.part(base, 1)), F.lit("://"), urls.part(base, 2))
    link = F.regexp_extract(blank(page), r"(?i)href=[\"']([^\"']*/products/ejournals/html/[^\"']+)[\"']", 1)
    return (
        F.when(at & F.contains(path, F.lit("/products/ejournals/abstract/")), F.concat(root, F.regexp_replace(path, "^(.*?)/abstract/", "$1/html/")))
        .when(at & (link != ""), absolute(base, link)).otherwise("")
    )


def resolved_kind(kind: Column, final_url: Column) -> Column:
    """The kind of a location once its final URL is known: a full article's page is html."""
    from . import urls

    open_ = F.lower(kind).isin("landing", "doi", "webpage")
    return F.when(open_ & urls.is_full_article_url(final_url), "html").otherwise(kind)


def landing_rejection(kind: Column, resolved: Column, final_url: Column, title: Column, accepted: Column) -> Column:
    """Why a landing page is not taken as the article: access_landing, publisher_landing or weak_landing; empty if it may be."""
    from . import urls

    access, landing = is_access_title(title), F.lower(kind).isin("landing", "doi", "webpage")
    return (
        F.when(F.lower(resolved) == "html", F.when(access, "access_landing").otherwise("")).when(~landing, "").when(access, "access_landing")
        .when(urls.is_abstract_or_chapter_url(final_url), "publisher_landing").when(accepted, "weak_landing").otherwise("")
    )


def valid_preprint_html(page: Column, least: int = 200) -> Column:
    """ok, reason and text_chars of a fetched preprint page."""
    from .text import strip_html as stripped

    chars, tagged = F.length(stripped(page)), F.contains(F.lower(F.substring(blank(page), 1, 2000)), F.lit("<html"))
    reason = F.when(~tagged, "missing_html_tag").when(chars < least, "too_little_text").otherwise("ok")
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"), F.when(tagged, chars).otherwise(0).cast("long").alias("text_chars"))


def with_title_fit(pages: DataFrame, expected: str, out: str = "title_ok") -> DataFrame:
    """Adds whether a page with title and text is about an expected title: by likeness of the titles, or by its words.

    The likeness is a column of its own, so only the two titles travel to Python.
    """
    from .text import title_match_score, title_tokens, token_hits_suffice

    scored = pages.withColumn("_expected", normalize_space(F.col(expected))).withColumn("_score", title_match_score(F.col("_expected"), F.col("title")))
    alike = (blank(F.col("title")) != "") & (F.col("_score") >= 0.65)
    fits = (F.col("_expected") == "") | ((blank(F.col("text")) != "") & (alike | token_hits_suffice(title_tokens(F.col("_expected")), F.lower("text"))))
    return scored.withColumn(out, fits).drop("_expected", "_score")

"""Counts that an audit takes from a stored article page: one parse for the elements, patterns for the rest."""

from __future__ import annotations

import base64
import re
import urllib.parse
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .documents import Node, parse, targets

# The counts, in the order in which a report has them.
COUNTS = (
    "links", "local_fragment_unresolved", "absolute_fragment_links", "absolute_fragment_links_resolve_local", "images", "image_missing_src", "image_remote_src", "image_relative_src",
    "image_relative_missing_file", "image_data_non_image_mime", "image_bad_data_url", "image_empty_alt", "picture_inline_data_img_with_source", "figures", "figure_without_media_warning",
    "latexml_figure_render_error", "latexml_rowcolor_artifacts", "frontiers_reference_buttons", "frontiers_empty_article_reference_links", "frontiers_figure_js_controls", "pmc_dead_ui_controls",
    "web_doc_mains", "tables", "table_rows", "table_cells", "table_without_rows", "def_lists", "latexml_caption_transformed_blocks", "latexml_tables", "latexml_itemize_marker_blocks",
    "latexml_inline_black_text_styles", "latexml_black_mathcolor_attrs", "disp_formula_tables", "display_math_blocks", "scripts", "springer_table_placeholder_markers",
)
# Elements that fill a figure, suffixes of supplements, marks of dead controls.
FIGURE_MEDIA = frozenset(("audio", "canvas", "embed", "iframe", "img", "math", "object", "picture", "svg", "video", "table"))
SUPPLEMENTS = (".bib", ".csv", ".doc", ".docx", ".m4v", ".mov", ".mp4", ".mpeg", ".mpg", ".pdf", ".ppt", ".pptx", ".qt", ".txt", ".webm", ".xls", ".xlsx", ".zip")
DEAD_CLASSES = ("citation-dialog-trigger", "collections-dialog-trigger", "collections-action-panel-form", "export-button", "pmc-permalink__dropdown__copy__btn", "usa-accordion__button")
#: Counts by pattern, over the page without scripts and styles; `{0}` opens a tag with a class.
CLASSED = r"<{0}\b(?=[^>]*\bclass\s*=\s*['\"][^'\"]*\b{1}\b)"
PATTERNS = {
    "springer_table_placeholder_markers": r"/tables/\d+\b", "latexml_rowcolor_artifacts": r"(?:\\rowcolor|<span\b(?=[^>]*\bltx_ERROR\b)[^>]*>\s*\\rowcolor\s*</span>)",
    "def_lists": CLASSED.format("dl", "def-list"), "latexml_tables": CLASSED.format("figure", "ltx_table"), "disp_formula_tables": CLASSED.format("table", "disp-formula"),
    "display_math_blocks": r"<math\b(?=[^>]*\bdisplay\s*=\s*['\"]block['\"])", "latexml_black_mathcolor_attrs": r"\bmathcolor\s*=\s*['\"]\s*(?:#000(?:000)?|black)\s*['\"]",
    "latexml_inline_black_text_styles": CLASSED.format("span", "ltx_text") + r"(?=[^>]*\bstyle\s*=\s*['\"][^'\"]*\bcolor\s*:\s*(?:#000(?:000)?|black)\b)",
    "latexml_itemize_marker_blocks": CLASSED.format("li", "ltx_item") + r"[^>]*>\s*" + CLASSED.format("span", "ltx_tag_item") + r"[^>]*>[\s\S]{0,120}</span>\s*" + CLASSED.format("div", "ltx_para"),
}
#: Style rules that a polished page brings, each shown by all of its texts.
STYLE_RULES = {
    "def_list": ("dl.def-list",), "latexml_caption": (".ltx_caption .ltx_transformed_outer",), "latexml_table": ("figure.ltx_table > figcaption", "figure.ltx_table table"),
    "latexml_itemize": (".ltx_item > .ltx_tag_item",), "formula": ("table.disp-formula td.label",),
}
_COMPILED = {name: re.compile(p, re.IGNORECASE) for name, p in PATTERNS.items()}
_IGNORED = re.compile(r"<(?:script|style)\b[^>]*>[\s\S]*?</(?:script|style)>", re.IGNORECASE)
# Marks of polished pages.
STYLE_MARK, DOCUMENT_ID, KIND_MARK = ("data-z2m-style", "web-html-polish"), "web-doc", "data-z2m-source-kind"


def _split(url: str) -> urllib.parse.SplitResult | None:
    try:
        return urllib.parse.urlsplit(url)
    except ValueError:
        return None


def is_local_fragment(url: urllib.parse.SplitResult) -> bool:
    return bool(url.fragment) and not (url.scheme or url.netloc or url.path or url.query)


def declared_urls(root: Node) -> list[str]:
    """The document's own URLs that its head declares, each once."""
    found: list[str] = []
    for n in root.find_all("link", "meta"):
        name = (n.attrs.get("name") or n.attrs.get("property") or "").lower()
        own = name in ("citation_full_html_url", "citation_public_url", "citation_abstract_html_url", "og:url")
        url = n.attrs.get("href", "") if "canonical" in n.attrs.get("rel", "").lower() else n.attrs.get("content", "") if own else ""
        if url.startswith(("http://", "https://")) and url not in found:
            found.append(url)
    return found


def document_urls(root: Node, known: set[str], *given: str) -> set[str]:
    """The document's own URLs without fragments: given and declared ones, else what its links tell.

    Without any, it is the one URL whose links to fragments of the document are the most, two at least.
    """
    own = [urllib.parse.urldefrag(u)[0] for u in (*given, *declared_urls(root)) if u]
    if own:
        return set(own)
    counts: Counter[str] = Counter()
    for a in root.find_all("a"):
        base, fragment = urllib.parse.urldefrag(a.attrs.get("href", "").strip())
        if fragment and base.startswith(("http://", "https://")) and (not known or urllib.parse.unquote(fragment) in known):
            counts[base] += 1
    best = counts.most_common(2)
    return {best[0][0]} if best and best[0][1] >= 2 and (len(best) == 1 or best[1][1] < best[0][1]) else set()


def is_dead_control(n: Node) -> bool:
    """A control of an archive's page that does nothing in a stored copy."""
    a = n.attrs
    button = n.tag == "button" and (
        a.get("aria-label") == "Show article permalink" or a.get("aria-controls") == "journal_context_menu" or "d-button" in a.get("class", "").split() and bool(a.get("aria-controls"))
    )
    return button or n.tag == "form" and a.get("id") == "collections-action-dialog-form" or any(c in a.get("class", "") for c in DEAD_CLASSES)


def is_figure_control(n: Node) -> bool:
    """A button that opens or loads a figure by script."""
    classes, event, label = (n.attrs.get(k, "") for k in ("class", "data-event", "aria-label"))
    icon = "ButtonIcon" in classes and (event.startswith(("articleFigure-", "articleTable-")) or label.startswith(("Expand ", "Download ")))
    return n.tag == "button" and ("ArticleFigure__figureButton" in classes or icon)


def is_supplement(href: str) -> bool:
    url = _split(href)
    path = urllib.parse.unquote((url.path if url else "") or href.split("?")[0].split("#")[0]).lower()
    return path.endswith(SUPPLEMENTS) or any(f"{s}{c}" in href.lower() for s in SUPPLEMENTS for c in "?#")


def _data_image(src: str) -> tuple[bool, bool]:
    """Whether a data URL names a type that is no image, and whether it is broken."""
    head, comma, data = src.partition(",")
    if not comma:
        return False, True
    kind = head[5:].split(";")[0].strip().lower()
    broken = False
    if ";base64" in head.lower() and len(data) < 2_000_000:
        try:
            base64.b64decode(data, validate=True)
        except ValueError:
            broken = True
    return bool(kind) and not kind.startswith("image/"), broken


def _asset(src: str) -> str:
    """The path of a relative source below the page's folder."""
    return "/".join(p for p in urllib.parse.unquote(src.split("?")[0].split("#")[0]).replace("\\", "/").split("/") if p)


def _with_ancestors(root: Node) -> Iterator[tuple[Node, tuple[Node, ...]]]:
    """Elements in order with the figures and pictures they stand in."""
    stack: list[tuple[Node, tuple[Node, ...]]] = [(root, ())]
    while stack:
        node, above = stack.pop()
        yield node, above
        below = (*above, node) if node.tag in ("figure", "picture") else above
        stack.extend((c, below) for c in reversed(node.children) if c.tag)


def audit_page(page: str, files: list[str] | None = None, url: str = "") -> dict:
    """Counts and marks of a page; `files` are the paths that exist below its folder (None: not known)."""
    out: dict = dict.fromkeys(COUNTS, 0)
    root = parse(page)
    known, have = targets(root), None if files is None else set(files)
    own = document_urls(root, known, url)
    hosts: Counter[str] = Counter()
    unresolved: list[str] = []
    missing: list[str] = []
    filled: set[int] = set()
    pictures: dict[int, set[str]] = {}
    figures: list[Node] = []
    marks = {"style_ok": False, "source_kind": ""}
    for n, above in _with_ancestors(root):
        a, classes = n.attrs, n.attrs.get("class", "")
        inside = [f for f in above if f.tag == "figure"]
        if n.tag in FIGURE_MEDIA:
            filled |= {id(f) for f in inside}
        if n.tag == "figure":
            out["figures"] += 1
            figures.append(n)
            if any(c in classes.lower() for c in ("ltx_table", "ltx_lstlisting")):
                filled.add(id(n))
        elif inside and "ltx_error" in classes.lower():
            out["latexml_figure_render_error"] += 1
        if n.tag == "picture":
            pictures[id(n)] = set()
        elif n.tag == "source":
            for p in above:
                if p.tag == "picture":
                    pictures[id(p)].add("source")
        elif n.tag == "script":
            out["scripts"] += 1
        elif n.tag == "style":
            marks["style_ok"] |= a.get(STYLE_MARK[0]) == STYLE_MARK[1]
        elif n.tag == "main" and a.get("id") == DOCUMENT_ID:
            out["web_doc_mains"] += 1
            marks["source_kind"] = a.get(KIND_MARK, "").strip()
        elif n.tag == "table":
            out["tables"] += 1
            out["table_without_rows"] += not any(True for _ in n.find_all("tr"))
        elif n.tag == "tr":
            out["table_rows"] += 1
        elif n.tag in ("td", "th"):
            out["table_cells"] += 1
        elif n.tag == "img":
            _count_image(a, above, out, hosts, missing, pictures, have)
        elif n.tag == "a":
            href = a.get("href", "").strip()
            if "ArticleReference" in classes.split() and not href and a.get("data-event", "").lower().startswith("articlereference-a-"):
                out["frontiers_empty_article_reference_links"] += 1
            if href:
                out["links"] += 1
                target = _split(href)
                if target is not None and target.fragment:
                    there = urllib.parse.unquote(target.fragment) in known
                    if target.scheme in ("http", "https"):
                        out["absolute_fragment_links"] += 1
                    if is_local_fragment(target):
                        if not there:
                            out["local_fragment_unresolved"] += 1
                            unresolved.append(href)
                    elif urllib.parse.urldefrag(href)[0] in own and (there or not known):
                        out["absolute_fragment_links_resolve_local"] += 1
                if is_supplement(href):
                    filled |= {id(f) for f in inside}
        if n.tag == "button" and "ArticleReference" in classes.split():
            out["frontiers_reference_buttons"] += 1
        out["frontiers_figure_js_controls"] += is_figure_control(n)
        out["pmc_dead_ui_controls"] += is_dead_control(n)
    out["figure_without_media_warning"] = sum(id(f) not in filled for f in figures)
    out["picture_inline_data_img_with_source"] = sum(held >= {"source", "inline"} for held in pictures.values())
    bare = _IGNORED.sub("", page)
    for name, pattern in _COMPILED.items():
        out[name] = sum(1 for _ in pattern.finditer(bare))
    out["latexml_caption_transformed_blocks"] = int("ltx_caption" in bare and "ltx_transformed_outer" in bare)
    rules = [name for name, texts in STYLE_RULES.items() if all(t in page for t in texts)]
    return {
        "counts": out, **marks, "style_rules": rules, "text_length": len(root.visible()), "remote_hosts": [{"host": h, "n": n} for h, n in hosts.most_common(20)],
        "unresolved": unresolved[:20], "missing": missing[:20],
    }


def _count_image(a: dict[str, str], above: tuple[Node, ...], out: dict, hosts: Counter[str], missing: list[str], pictures: dict[int, set[str]], have: set[str] | None) -> None:
    out["images"] += 1
    out["image_empty_alt"] += not a.get("alt", "").strip()
    src = a.get("src", "").strip()
    if not src:
        out["image_missing_src"] += 1
    elif src[:5].lower() == "data:":
        if src.lower().startswith("data:image/"):
            for p in above:
                if p.tag == "picture":
                    pictures[id(p)].add("inline")
        other, broken = _data_image(src)
        out["image_data_non_image_mime"] += other
        out["image_bad_data_url"] += broken
    else:
        url = _split("https:" + src if src.startswith("//") else src)
        if url is not None and url.scheme in ("http", "https"):
            out["image_remote_src"] += 1
            if url.netloc:
                hosts[url.netloc.lower()] += 1
        elif url is None or not url.scheme:
            out["image_relative_src"] += 1
            if have is not None and _asset(src) not in have:
                out["image_relative_missing_file"] += 1
                missing.append(src)


AUDITED = T.StructType(
    [
        T.StructField("counts", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])), T.StructField("style_ok", T.BooleanType()), T.StructField("source_kind", T.StringType()),
        T.StructField("style_rules", T.ArrayType(T.StringType())), T.StructField("text_length", T.LongType()),
        T.StructField("remote_hosts", T.ArrayType(T.StructType([T.StructField("host", T.StringType()), T.StructField("n", T.LongType())]))),
        T.StructField("unresolved", T.ArrayType(T.StringType())), T.StructField("missing", T.ArrayType(T.StringType())),
    ]
)


@pandas_udf(AUDITED)
def _audited(page: pd.Series, files: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [audit_page(html_ or "", None if f is None else list(f), u or "") for html_, f, u in zip(page, files, url)]
    return pd.DataFrame(rows, columns=[f.name for f in AUDITED.fields])


def audited(page: Column, files: Column | None = None, url: Column | None = None) -> Column:
    """Everything that an audit reads from a page, as one struct."""
    return _audited(page, F.lit(None).cast("array<string>") if files is None else files, F.lit(None).cast("string") if url is None else url)


# Ids, roles and types that mark references.
REFERENCE_ID = re.compile(r"^(?:(?:ref|bib|bibr|citation|cit|iopbib|en)(?:[-_.:].*|\d.*)|[br]\d+)$", re.IGNORECASE)
REFERENCE_ROLES, REFERENCE_TYPES = frozenset(("doc-biblioref", "doc-biblioentry", "doc-endnote")), frozenset(("biblioref", "biblioentry", "endnote"))


def is_reference(attrs: dict[str, str]) -> bool:
    """Whether an element is a reference or points to one."""
    href = attrs.get("href", "")
    named = REFERENCE_ID.match(attrs.get("id", "")) or REFERENCE_ID.match(href[1:] if href.startswith("#") else "")
    return bool(named or REFERENCE_ROLES & set(attrs.get("role", "").lower().split()) or REFERENCE_TYPES & set(attrs.get("epub:type", "").lower().split()))


def semantic_counts(root: Node) -> dict[str, int]:
    """Sections, figures and references of a document, and how many of them have an id (references always count)."""
    out = {f"{kind}_{what}": 0 for kind in ("section", "figure", "reference") for what in ("total", "annotated")}
    for n in root.walk():
        if n.tag in ("section", "figure"):
            out[f"{n.tag}_total"] += 1
            out[f"{n.tag}_annotated"] += bool(n.attrs.get("id"))
        if n.tag and is_reference(n.attrs):
            out["reference_total"] += 1
            out["reference_annotated"] += 1
    return out


SEMANTICS = T.StructType([T.StructField(f"{kind}_{what}", T.LongType()) for kind in ("section", "figure", "reference") for what in ("total", "annotated")])


@pandas_udf(SEMANTICS)
def semantics(page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([semantic_counts(parse(p or "")) for p in page], columns=[f.name for f in SEMANTICS.fields])

"""What each publisher's pages need on top of the common rewrites, as passes over the parsed tree.

A handler is a function on the tree; `HANDLERS` names one for each kind of page.  All of them point
references and floats at targets inside the document, so a stored article needs no network.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .documents import Node, absolutize, canonical_links, drop_empty, drop_marked, parse, render, restore_images, sanitize, targets

# Prefixes that publishers give to ids of figures and tables, and class words of page furniture.
FIGURE_PREFIXES = ("FIG", "Fig", "fig", "F", "f", "figure", "Figure")
TABLE_PREFIXES = ("T", "t", "TAB", "Tab", "tab", "TABLE", "Table", "table", "tbl")
FURNITURE = {
    "pmc_article": frozenset(("ctxp", "pmc-sidebar", "usa-banner", "ncbi-header", "share-buttons")), "springer_nature_article": frozenset(("c-article-extras", "c-article-recommendations", "app-card-open", "c-pdf-download")),
    "taylor_francis_article": frozenset(("tocarticleengine", "relateditem", "sharetools")), "iop_article": frozenset(("cookie-banner", "secondary-header", "wd-share")),
    "arxiv_latexml": frozenset(("ltx_page_navbar", "ltx_page_footer", "package-alerts", "html-header-nav")),
}
_FIGURE_PATH = re.compile(r"/figures?/(?P<label>[A-Za-z]*)(?P<number>\d+)/?$", re.IGNORECASE)
_TABLE_PATH = re.compile(r"/tables?/(?P<label>[A-Za-z]*)(?P<number>\d+)/?$", re.IGNORECASE)


def float_target(href: str, ids: set[str]) -> str | None:
    """The id in the document for a link to a figure's or table's own page."""
    path = urllib.parse.unquote(urllib.parse.urlsplit(href).path)
    for pattern, prefixes in ((_FIGURE_PATH, FIGURE_PREFIXES), (_TABLE_PATH, TABLE_PREFIXES)):
        found = pattern.search(path)
        if found:
            names = [found["label"] + found["number"], *(p + found["number"] for p in prefixes)]
            lower = {i.lower(): i for i in ids}
            return next((n for n in names if n in ids), None) or next((lower[n.lower()] for n in names if n.lower() in lower), None)
    return None


def data_target(value: str, ids: set[str]) -> str:
    """The fragment for a data id: the id itself or one of its wrappers, exact before any case."""
    words = value.strip().lstrip("#").split()
    if not words:
        return "#"
    lower = {i.lower(): i for i in ids}
    for name in (words[0], f"{words[0]}-table-wrapper", f"{words[0]}-figure-wrapper", f"{words[0]}-wrapper"):
        if name in ids or name.lower() in lower:
            return "#" + (name if name in ids else lower[name.lower()])
    return "#" + words[0]


def path_tokens(url: str) -> set[str]:
    """The last path segment of an article's URL, and its DOI where the segment before starts one."""
    parts = [urllib.parse.unquote(p).strip().lower() for p in urllib.parse.urlsplit(url or "").path.split("/") if p.strip()]
    return {parts[-1], *([f"{parts[-2]}/{parts[-1]}"] if len(parts) > 1 and parts[-2].startswith("10.") else [])} if parts else set()


def _retarget_floats(root: Node, url: str) -> None:
    ids = targets(root)
    for a in root.find_all("a"):
        if a.attrs.get("href") and (target := float_target(a.attrs["href"], ids)):
            a.attrs["href"] = "#" + target


def pmc(root: Node, url: str) -> None:
    _retarget_floats(root, url)


def springer(root: Node, url: str) -> None:
    """Links to the same article elsewhere become local, labels point to their containers."""
    own, ids = path_tokens(url), targets(root)
    for a in root.find_all("a"):
        base, fragment = urllib.parse.urldefrag(a.attrs.get("href", ""))
        if fragment and fragment in ids and base and path_tokens(base) & own:
            a.attrs["href"] = "#" + fragment
    containers: dict[str, str] = {}
    for box in root.find_all("div", "figure"):
        kind = next((k for k in ("figure", "table") if k in box.attrs.get("data-container-section", "") or k in box.attrs.get("data-test", "")), None)
        if kind and box.attrs.get("id"):
            for n in box.walk():
                label = n.attrs.get("id", "")
                if label and label != box.attrs["id"] and label.lower().startswith(("fig",) if kind == "figure" else ("tab", "table")):
                    containers.setdefault(label, box.attrs["id"])
                    break
    for a in root.find_all("a"):
        href = a.attrs.get("href", "")
        if href.startswith("#") and href[1:] in containers:
            a.attrs["href"] = "#" + containers[href[1:]]
    _retarget_floats(root, url)


def taylor_francis(root: Node, url: str) -> None:
    ids = targets(root)
    for a in root.find_all("a"):
        for key in ("data-rid", "data-id"):
            if a.attrs.get(key):
                a.attrs["href"] = data_target(a.attrs[key], ids)
                break


def iop(root: Node, url: str) -> None:
    """References given as meta fields become a list that the links can point to."""
    values = [m.attrs.get("content", "") for m in root.find_all("meta") if m.attrs.get("name") == "citation_reference"]
    ids = targets(root)
    base = _most_common([re.sub(r"\d+$", "", a.attrs["href"][1:]) for a in root.find_all("a") if re.match(r"#[A-Za-z]+.*\d$", a.attrs.get("href", ""))])
    rows = [Node("li", {"id": f"{base}{i}"}, [Node(text=render_reference(v))]) for i, v in enumerate(values, 1) if base and f"{base}{i}" not in ids]
    body = next(root.find_all("article", "body"), root)
    if rows:
        body.children.append(Node("ol", {"class": "references"}, rows))


def _most_common(values: list[str]) -> str:
    counts: dict[str, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    return max(counts, key=lambda v: counts[v]) if counts else ""


def latexml(root: Node, url: str) -> None:
    """Black text and white table backgrounds of converted TeX go, so pages follow their own style."""
    for n in root.walk():
        style = n.attrs.get("style", "")
        if style:
            kept = [d for d in (x.strip() for x in style.split(";")) if d and not re.match(r"(--ltx-)?(fg|bg)?-?(background-)?color\s*:\s*(#0{3,8}|black|#f{3,8}|white)\b", d, re.IGNORECASE)]
            n.attrs["style"] = "; ".join(kept)
            if not kept:
                del n.attrs["style"]
    for n in list(root.walk()):
        n.children = [c for c in n.children if not ("ltx_ERROR" in c.attrs.get("class", "") and "undefined" in c.attrs.get("class", ""))]


HANDLERS: dict[str, Callable[[Node, str], None]] = {"pmc_article": pmc, "springer_nature_article": springer, "taylor_francis_article": taylor_francis, "iop_article": iop, "arxiv_latexml": latexml}


def reference_fields(value: str) -> dict[str, list[str]]:
    """`key=value;` pairs of a reference, values of one key in order."""
    out: dict[str, list[str]] = {}
    for part in value.split(";"):
        key, equals, content = part.partition("=")
        if equals and key.strip() and content.strip():
            out.setdefault(key.strip(), []).append(content.strip())
    return out


def render_reference(value: str) -> str:
    """A reference's fields as a line: authors, year, title, journal, volume, pages, DOI."""
    f = reference_fields(value)
    get = lambda k: ", ".join(f.get(f"citation_{k}", []))
    parts = [get("author"), get("publication_date") or get("year"), get("title"), get("journal_title"), get("volume"), get("firstpage"), get("doi")]
    return ". ".join(p for p in parts if p) or value.strip()


def normalize(page: str, kind: str, url: str) -> str:
    """A page of a known kind, cleaned by its handler and the common passes."""
    root = parse(page)
    drop_marked(root, FURNITURE.get(kind, frozenset()))
    if kind in HANDLERS:
        HANDLERS[kind](root, url)
    restore_images(root)
    sanitize(root)
    canonical_links(root, (url,))
    if url:
        absolutize(root, url)
    drop_empty(root)
    return render(root)


@pandas_udf(T.StringType())
def normalize_page(page: pd.Series, kind: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([normalize(p or "", k or "", u or "") for p, k, u in zip(page, kind, url)], dtype="object")


#: Kinds that are landing pages and not articles.
LANDING_KINDS = ("arxiv_abs_page", "sciendo_abstract_page", "ojs_abstract_page", "researchgate_page", "unknown")


def is_article_kind(kind: Column) -> Column:
    return ~kind.isin(*LANDING_KINDS)


PROFILE = {"data-article-profile": "canonical-article", "data-article-profile-version": "1"}


def stamp(page: str, kind: str, provenance: str) -> str:
    """Mark the document's main element as the canonical root; any other main loses such marks."""
    root = parse(page)
    wanted = "web-doc" if kind == "source" else "marker-doc"
    mains = [n for n in root.find_all("main") if n.attrs.get("id") == wanted]
    if kind not in ("source", "pdf") or len(mains) != 1 or not provenance.strip():
        raise ValueError("one root, a known kind and a provenance are needed")
    for n in root.find_all("main"):
        for name in (*PROFILE, "data-document-kind", "data-provenance-kind"):
            n.attrs.pop(name, None)
    mains[0].attrs |= {**PROFILE, "data-document-kind": kind, "data-provenance-kind": provenance.strip()}
    return render(root)


def contract_report(page: str) -> dict:
    """Whether a document keeps the canonical contract: status, failures and warnings."""
    root = parse(page)
    mains = [n for n in root.walk() if "data-article-profile" in n.attrs]
    failures, warnings = [], []
    if len(mains) != 1:
        failures.append("document_root_count")
    else:
        attrs = mains[0].attrs
        failures += ["profile_mismatch"] * (attrs["data-article-profile"] != PROFILE["data-article-profile"])
        failures += ["profile_version_mismatch"] * (attrs.get("data-article-profile-version") != "1")
        kind = attrs.get("data-document-kind")
        failures += ["document_kind_invalid"] * (kind not in ("source", "pdf"))
        failures += ["document_root_id_mismatch"] * (kind in ("source", "pdf") and attrs.get("id") != ("web-doc" if kind == "source" else "marker-doc"))
        failures += ["provenance_missing"] * (not attrs.get("data-provenance-kind"))
    ids = [n.attrs["id"] for n in root.walk() if n.attrs.get("id")]
    failures += ["duplicate_ids"] * (len(ids) != len(set(ids)))
    wanted = {urllib.parse.unquote(a.attrs["href"][1:]) for a in root.find_all("a") if a.attrs.get("href", "").startswith("#") and len(a.attrs["href"]) > 1}
    warnings += ["missing_internal_link_targets"] * bool(wanted - targets(root))
    for tag in ("section", "figure"):
        failures += [f"{tag}_semantics_missing"] * any(not n.attrs.get("id") for n in root.find_all(tag))
    return {"status": "failed" if failures else "warning" if warnings else "passed", "failures": failures, "warnings": warnings}

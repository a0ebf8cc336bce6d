"""Rewrites of whole HTML documents in one parse, and the metrics that an audit takes.

A document is parsed once into a tree of light nodes; every rewrite is a pass over that tree, and the
result is written once.  The passes are idempotent: a document that went through them stays as it is.
The column functions run them through Arrow, one struct for each document.
"""

from __future__ import annotations

import base64
import html
import re
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Elements and attributes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ACTIVE = frozenset("script style noscript template iframe object embed applet form input button select textarea".split())
MEDIA = frozenset("audio video".split())
KEPT_ATTRIBUTES = frozenset("alt cite class colspan content datetime dir href id lang name role rowspan scope src srcset start title type width height".split())
URL_ATTRIBUTES = ("href", "src", "cite")
SAFE_SCHEMES = frozenset(("", "http", "https", "mailto", "data"))
LAZY_SOURCES = ("data-src", "data-original", "data-lazy-src")
IMAGE_MAGIC = {"image/png": b"\x89PNG\r\n\x1a\n", "image/jpeg": b"\xff\xd8\xff", "image/gif": b"GIF8", "image/webp": b"RIFF"}
POLISHED = "data-article-root"


@dataclass
class Node:
    """An element (`tag` set) or a piece of text."""

    tag: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)
    text: str = ""

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find_all(self, *tags: str) -> Iterator["Node"]:
        return (n for n in self.walk() if n.tag in tags)

    def visible(self) -> str:
        """Text below the node, scripts and styles left out, white space collapsed."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag in ("script", "style"):
                continue
            parts.append(node.text)
            if node.tag:
                parts.append(" ")
            stack.extend(reversed(node.children))
        return " ".join(" ".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(Node(text=data))


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def render(root: Node) -> str:
    """The document as HTML; walks without recursion, so depth has no bound."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif not node.tag:
            out.append(html.escape(node.text, quote=False))
        else:
            if node.tag != "#root":
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}>")
                if node.tag in VOID:
                    continue
                stack.append(f"</{node.tag}>")
            stack.extend(reversed(node.children))
    return "".join(out)


def _keep(root: Node, test: Callable[[Node], bool]) -> None:
    for node in list(root.walk()):
        node.children = [c for c in node.children if not c.tag or test(c)]


def sanitize(root: Node) -> None:
    """Drop active elements, and attributes that are not on the list or point to unsafe schemes."""
    _keep(root, lambda n: n.tag not in ACTIVE)
    for node in root.walk():
        kept = {}
        for name, value in node.attrs.items():
            if name not in KEPT_ATTRIBUTES and not name.startswith(("data-", "aria-")):
                continue
            if name in URL_ATTRIBUTES and _scheme(value) not in SAFE_SCHEMES:
                continue
            kept[name] = value
        node.attrs = kept


def _scheme(value: str) -> str:
    clean = re.sub(r"[\x00-\x20]+", "", value)
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", clean)
    return found[1].lower() if found else ""


def replace_media(root: Node, base: str) -> None:
    """Audio and video become links to their sources."""
    for node in root.walk():
        if node.tag in MEDIA:
            source = node.attrs.get("src") or next((c.attrs.get("src", "") for c in node.find_all("source")), "")
            where = urllib.parse.urljoin(base, source)
            label = Node(text=f"[{node.tag}: {where}]")
            node.tag, node.attrs, node.children = "p", {"class": "media-source"}, [Node("a", {"href": where}, [label]) if where else label]


def restore_images(root: Node) -> None:
    """Lazily loaded images get their source; images without any are dropped."""
    for node in root.find_all("img"):
        if not node.attrs.get("src", "").strip():
            node.attrs["src"] = next((node.attrs[k] for k in LAZY_SOURCES if node.attrs.get(k)), "")
    _keep(root, lambda n: n.tag != "img" or bool(n.attrs.get("src", "").strip()))


def absolutize(root: Node, base: str) -> None:
    """Relative URLs on the base; fragments and data stay."""
    for node in root.walk():
        for name in URL_ATTRIBUTES:
            value = node.attrs.get(name, "")
            if value and not value.startswith(("#", "data:", "mailto:")):
                node.attrs[name] = urllib.parse.urljoin(base, value)


def targets(root: Node) -> set[str]:
    return {n.attrs[k] for n in root.walk() for k in ("id", "name") if n.attrs.get(k)}


def canonical_links(root: Node, own_urls: tuple[str, ...]) -> tuple[int, int]:
    """Links to the document itself become fragments; links to fragments that are not there lose them.

    Returns how many were rewritten and how many disabled.
    """
    bases = {urllib.parse.urldefrag(u)[0] for u in own_urls if u}
    known, rewritten, disabled = targets(root), 0, 0
    for node in root.find_all("a"):
        href = node.attrs.get("href", "")
        base, fragment = urllib.parse.urldefrag(href)
        if fragment and base and base in bases and urllib.parse.unquote(fragment) in known:
            node.attrs["href"] = "#" + fragment
            rewritten += 1
        elif href.startswith("#") and len(href) > 1 and urllib.parse.unquote(href[1:]) not in known:
            del node.attrs["href"]
            disabled += 1
    return rewritten, disabled


def drop_empty(root: Node) -> None:
    """Drop tables without rows and figures without media or text."""
    _keep(root, lambda n: n.tag != "table" or any(True for _ in n.find_all("tr")))
    _keep(root, lambda n: n.tag != "figure" or bool(n.visible()) or any(True for _ in n.find_all("img", "svg", "table", "math")))


def drop_marked(root: Node, words: frozenset[str], tags: tuple[str, ...] = ()) -> None:
    """Drop elements whose class or id holds one of the words."""

    def marked(n: Node) -> bool:
        tokens = set(re.split(r"[\s]+", f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()))
        return bool(tokens & words) and (not tags or n.tag in tags)

    _keep(root, lambda n: not marked(n))


@dataclass
class Fragment:
    node: Node | None
    selector: str
    score: int
    length: int


def best_fragment(root: Node, least: int = 200) -> Fragment:
    """The element that is most likely the article: by element, attributes, text and links, else the body."""
    best = Fragment(None, "", -1, 0)
    for node in root.walk():
        named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('role', '')} {node.attrs.get('itemprop', '')}".lower()
        if node.tag not in ("article", "main", "section", "div") or node.tag == "div" and not re.search(r"article|content|main|body|text|post", named):
            continue
        text = node.visible()
        if len(text) < (1 if node.tag in ("article", "main") else least):
            continue
        links = sum(len(a.visible()) for a in node.find_all("a"))
        score = {"article": 400, "main": 300, "section": 50, "div": 0}[node.tag] + 150 * bool(re.search(r"article|main", named)) + 100 * bool(re.search(r"body|content|text", named))
        score += min(len(text) // 100, 300) + 20 * min(sum(1 for _ in node.find_all("p")), 20) - 400 * links // len(text)
        if (score, len(text)) > (best.score, best.length):
            best = Fragment(node, node.tag, score, len(text))
    if best.node is None:
        body = next(root.find_all("body"), root)
        best = Fragment(body, "body", 0, len(body.visible()))
    return best


def title_of(root: Node) -> str:
    for key in ("citation_title", "og:title"):
        for meta in root.find_all("meta"):
            if key in (meta.attrs.get("name"), meta.attrs.get("property")) and meta.attrs.get("content", "").strip():
                return " ".join(meta.attrs["content"].split())
    return next((" ".join(n.visible().split()) for n in root.find_all("title")), "")


def polish(page: str, url: str = "") -> dict:
    """A document reduced to its article in a plain shell; what already is such a document stays so."""
    root = parse(page)
    title = title_of(root)
    known = next((n for n in root.walk() if POLISHED in n.attrs), None)
    chosen = Fragment(Node("#root", {}, known.children), known.attrs.get("data-selector", "body"), 0, 0) if known is not None else best_fragment(root)
    article = Node("#root", {}, chosen.node.children if chosen.node is not None else [])
    replace_media(article, url)
    restore_images(article)
    sanitize(article)
    if url:
        rewritten, disabled = canonical_links(article, (url,))
        absolutize(article, url)
    else:
        rewritten, disabled = canonical_links(article, ())
    drop_empty(article)
    body = render(article)
    shell = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title, quote=False)}</title></head><body><main {POLISHED}="1" data-selector="{chosen.selector}">{body}</main></body></html>'
    return {"html": shell, "title": title, "selector": chosen.selector, "text_chars": len(article.visible()), "links_rewritten": rewritten, "links_disabled": disabled}


METRICS = ("tags", "links", "fragment_links", "dangling_fragments", "images", "images_without_source", "data_images", "tables", "tables_without_rows", "figures", "empty_figures", "headings", "paragraphs", "lists", "scripts", "styles", "forms", "frames", "math", "ids", "duplicate_ids", "text_chars")


def metrics(page: str) -> dict[str, int]:
    """Counts over one parse of a document."""
    out = dict.fromkeys(METRICS, 0)
    root = parse(page)
    known, ids = targets(root), [n.attrs["id"] for n in root.walk() if n.attrs.get("id")]
    simple = {"a": "links", "img": "images", "table": "tables", "figure": "figures", "p": "paragraphs", "ul": "lists", "ol": "lists", "script": "scripts", "style": "styles", "form": "forms", "iframe": "frames", "math": "math"}
    for n in root.walk():
        if not n.tag or n.tag == "#root":
            continue
        out["tags"] += 1
        if n.tag in simple:
            out[simple[n.tag]] += 1
        if re.fullmatch("h[1-6]", n.tag):
            out["headings"] += 1
        href, src = n.attrs.get("href", ""), n.attrs.get("src", "").strip()
        if n.tag == "a" and href.startswith("#") and len(href) > 1:
            out["fragment_links"] += 1
            out["dangling_fragments"] += urllib.parse.unquote(href[1:]) not in known
        if n.tag == "img":
            out["images_without_source"] += not src
            out["data_images"] += src.startswith("data:")
        if n.tag == "table":
            out["tables_without_rows"] += not any(True for _ in n.find_all("tr"))
        if n.tag == "figure":
            out["empty_figures"] += not n.visible() and not any(True for _ in n.find_all("img", "svg", "table", "math"))
    out["ids"], out["duplicate_ids"], out["text_chars"] = len(ids), len(ids) - len(set(ids)), len(root.visible())
    return out


def decode_data_image(value: str) -> tuple[str, bytes] | None:
    """Type and bytes of a base64 data URI of an image; None if it is not one, or its bytes are another's."""
    found = re.fullmatch(r"data:(image/[a-z0-9.+-]+)(?:;[^,;]*)*;base64,([A-Za-z0-9+/=\s]*)", value.strip(), re.IGNORECASE)
    if not found:
        return None
    try:
        raw = base64.b64decode(re.sub(r"\s+", "", found[2]), validate=True)
    except ValueError:
        return None
    magic = IMAGE_MAGIC.get(found[1].lower())
    return (found[1].lower(), raw) if raw and (magic is None or raw.startswith(magic)) else None


_POLISH = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("html", "string"), ("title", "string"), ("selector", "string"), ("text_chars", "long"), ("links_rewritten", "long"), ("links_disabled", "long"))]})
_METRICS = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])


@pandas_udf(_POLISH)
def polish_page(page: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([polish(p or "", u or "") for p, u in zip(page, url)], columns=[f.name for f in _POLISH.fields])


@pandas_udf(_METRICS)
def page_metrics(page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metrics(p or "") for p in page], columns=list(METRICS))


def _sanitized(page: str) -> str:
    root = parse(page)
    sanitize(root)
    return render(root)


@pandas_udf(T.StringType())
def sanitize_page(page: pd.Series) -> pd.Series:
    return page.map(lambda p: _sanitized(p or ""))


@pandas_udf(T.StringType())
def join_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([urllib.parse.urljoin(b or "", r or "") for b, r in zip(base, ref)], dtype="object")


def audit_issues(m: str, text_least: int = 200) -> Column:
    """Critical issues over a metrics struct column, in their order."""
    c = lambda name: F.col(f"{m}.{name}")
    return F.array_compact(
        F.array(
            F.when(c("dangling_fragments") > 0, "unresolved_local_fragment_links"), F.when(c("images_without_source") > 0, "image_missing_src"), F.when(c("scripts") > 0, "script_tags_present"),
            F.when(c("tables_without_rows") > 0, "table_without_rows"), F.when(c("duplicate_ids") > 0, "duplicate_ids"), F.when(c("text_chars") < text_least, "short_text"),
        )
    )


def audit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Metrics, issues and warnings of every page, from one parse of each."""
    rows = pages.select(id_col, page_metrics(F.col(html_col)).alias("m"))
    warnings = F.array_compact(F.array(F.when(F.col("m.empty_figures") > 0, "figure_without_media_warning"), F.when(F.col("m.headings") == 0, "no_headings_warning")))
    return rows.select(id_col, "m", audit_issues("m").alias("issues"), warnings.alias("warnings"))

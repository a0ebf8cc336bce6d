"""Repairs of article pages over the parsed tree: reference links, block flow, equations, inlined assets.

Each repair is a pass over a tree (see `documents`); going through one again changes nothing.  Assets come as
a map from the paths that a page names to their bytes, so a page needs no file system.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .documents import IMAGE_MAGIC, Node, parse, render, targets

# Elements that do not belong in a paragraph, media that count as content, and marks.
LIFTED = frozenset(("ul", "ol", "table", "figure"))
INLINE_MEDIA = frozenset(("img", "picture", "svg", "math", "video", "canvas", "iframe", "object", "embed"))
CITATION, SOLO_MEDIA, SOLO_CELL = "ArticleReference", "standalone-media", "single-equation-cell"
EQUATION_PADDING = frozenset(("ltx_eqn_center_padleft", "ltx_eqn_center_padright", "ltx_eqn_eqno"))
STRONG_TOKENS = (
    "ltx_page_main", "pmc-article", "nlm_article", "c-article-body", "article__body", "article-body", "article__content", "article-content", "wd-jnl-art-full-text", "articlebody", "hlfld-fulltext",
    "main-content", "fulltext-view", "article-section",
)
IMAGE_BYTES, TOTAL_BYTES = 8 << 20, 64 << 20
_CSS_URL = re.compile(r"url\(\s*(?P<quote>[\"']?)(?P<ref>[^\"')]*?)(?P=quote)\s*\)", re.IGNORECASE)
_CSS_IMPORT = re.compile(r"@import\s+(?:url\(\s*)?(?P<quote>[\"']?)(?P<ref>[^\"')\s;]+)(?P=quote)\s*\)?[^;]*;", re.IGNORECASE)


def _classes(n: Node) -> list[str]:
    return n.attrs.get("class", "").split()


def reference_id(n: Node) -> str:
    """The reference that a citation control names: by its own id, else in its event; empty if neither does."""
    found = re.match(r"([A-Za-z]+\d+[A-Za-z]*)-button$", n.attrs.get("id", ""), re.IGNORECASE) or re.search(r"articleReference-a-([A-Za-z]+\d+[A-Za-z]*)\b", n.attrs.get("data-event", ""), re.IGNORECASE)
    return found[1] if found else ""


def link_references(root: Node) -> tuple[int, int]:
    """Citations by script become links to the references; returns how many were linked and how many could not be."""
    known = {t.lower(): t for t in targets(root)}
    linked = lost = 0
    for n in root.find_all("button", "a"):
        if CITATION not in _classes(n) or n.tag == "a" and n.attrs.get("href", "").strip():
            continue
        name = reference_id(n)
        target = known.get(name.lower()) if name else None
        if target:
            kept = {"id": n.attrs["id"]} if n.tag == "button" and n.attrs.get("id") else {}
            n.tag, n.attrs = "a", {"class": f"{CITATION} citation", "href": f"#{target}", **kept}
            linked += 1
        elif n.tag == "a" and name:
            n.tag, n.attrs = "span", {"class": f"{CITATION} unresolved-reference", "data-unresolved-reference": name}
            lost += 1
    return linked, lost


def _flows(nodes: list[Node]) -> bool:
    """Whether nodes hold text or media."""
    return any(n.text.strip() if not n.tag else n.visible() or any(m.tag in INLINE_MEDIA for m in n.walk()) for n in nodes)


def lift_blocks(root: Node) -> int:
    """Lists, tables and figures inside paragraphs stand between the paragraph's parts; returns how many were lifted."""
    lifted = 0
    stack = [root]
    while stack:
        node = stack.pop()
        out: list[Node] = []
        for child in node.children:
            if child.tag != "p" or not any(c.tag in LIFTED for c in child.children):
                out.append(child)
                continue
            part: list[Node] = []
            for c in [*child.children, None]:
                if c is not None and c.tag not in LIFTED:
                    part.append(c)
                    continue
                if _flows(part):
                    out.append(Node("p", dict(child.attrs), part))
                part = []
                if c is not None:
                    out.append(c)
                    lifted += 1
        node.children = out
        stack.extend(c for c in out if c.tag)
    return lifted


def frame_images(root: Node) -> int:
    """Paragraphs of nothing but images become figures; returns how many."""
    framed = 0
    for n in root.find_all("p"):
        rest = [c for c in n.children if c.tag not in ("img", "br")]
        if any(c.tag == "img" for c in n.children) and not _flows(rest):
            kept = {"id": n.attrs["id"]} if n.attrs.get("id", "").strip() else {}
            n.tag, n.attrs = "figure", {**kept, "class": " ".join([SOLO_MEDIA, *_classes(n)])}
            framed += 1
    return framed


def centre_equations(root: Node) -> int:
    """Equation rows with one cell besides padding and number mark that cell; returns how many."""
    marked = 0
    for row in root.find_all("tr"):
        if "ltx_equation" not in _classes(row):
            continue
        cells = [c for c in row.find_all("td") if not EQUATION_PADDING & set(_classes(c))]
        if len(cells) == 1 and SOLO_CELL not in _classes(cells[0]):
            cells[0].attrs["class"] = " ".join([*_classes(cells[0]), SOLO_CELL])
            marked += 1
    return marked


def starts_article(n: Node) -> bool:
    """Whether an element looks like the start of an article: by its name, or by a token of publishers."""
    named = " ".join(n.attrs.values()).lower()
    return n.tag in ("article", "main") or any(token in named for token in STRONG_TOKENS)


def table_page(root: Node, base: str) -> str:
    """The URL of a table's own page, by the first link that ends in its number; empty if there is none."""
    for a in root.find_all("a"):
        url = urllib.parse.urlsplit(urllib.parse.urljoin(base, a.attrs.get("href", "").strip()))
        if a.attrs.get("href", "").strip() and url.scheme.lower() in ("", "http", "https") and re.search(r"/tables/\d+/?$", urllib.parse.unquote(url.path), re.IGNORECASE):
            return urllib.parse.urlunsplit(url._replace(fragment=""))
    return ""


def media_type(raw: bytes, fallback: str = "") -> str:
    """The type of an image by its first bytes, else the fallback."""
    return next((kind for kind, magic in IMAGE_MAGIC.items() if raw.startswith(magic) and (kind != "image/webp" or raw[8:12] == b"WEBP")), "image/svg+xml" if raw.lstrip()[:5].lower() in (b"<svg ", b"<?xml") and b"<svg" in raw[:1000].lower() else fallback)


def data_url(raw: bytes, kind: str) -> str:
    return f"data:{kind};base64,{base64.b64encode(raw).decode()}"


def is_same_data(url: str, raw: bytes, most: int = IMAGE_BYTES) -> bool:
    """Whether a data URL of an image decodes to exactly these bytes, within a limit."""
    head, comma, content = url.partition(",")
    if not head.startswith("data:image/") or not comma or len(raw) > most:
        return False
    try:
        made = base64.b64decode(content, validate=True)
    except ValueError:
        return False
    return hashlib.sha256(made).digest() == hashlib.sha256(raw).digest()


class Assets:
    """Assets of a page under budgets: bytes of one, and of all together, each counted once."""

    def __init__(self, files: dict[str, bytes], most: int = IMAGE_BYTES, total: int = TOTAL_BYTES):
        self.files, self.most, self.left, self.made = files, most, total, dict[str, str | None]()

    def url(self, ref: str, fallback: str = "") -> str | None:
        """The data URL of a reference, None where it has no asset, is no image, or is over a budget."""
        raw = self.files.get(ref)
        if raw is None:
            return None
        if ref not in self.made:
            kind, fits = media_type(raw, fallback), len(raw) <= min(self.most, self.left)
            self.made[ref] = data_url(raw, kind) if kind and fits else None
            self.left -= len(raw) if kind and fits else 0
        return self.made[ref]


def inline_images(root: Node, assets: Assets) -> int:
    """Sources and source sets of images become data URLs where there is an asset; returns how many."""
    done = 0
    for n in root.find_all("img", "source"):
        made = assets.url(n.attrs.get("src", "").strip()) if n.tag == "img" else None
        if made:
            n.attrs = {**n.attrs, "data-source": n.attrs["src"].strip(), "src": made}
            done += 1
        entries = [e.split() for e in re.split(r",\s+", n.attrs.get("srcset", "").strip()) if e.split()]
        if entries and "data:" not in n.attrs["srcset"].lower():
            new = [[assets.url(e[0]) or e[0], *e[1:]] for e in entries]
            done += sum(a[0] != b[0] for a, b in zip(entries, new))
            n.attrs["srcset"] = ", ".join(" ".join(e) for e in new)
    return done


def inline_css(css: str, assets: Assets, depth: int = 4) -> str:
    """A style sheet with its imports and assets put in; what has no asset stays as it is."""

    def imported(m: re.Match) -> str:
        raw = assets.files.get(m["ref"])
        return inline_css(raw.decode("utf-8", "replace"), assets, depth - 1) if raw is not None and depth else m[0]

    def put(m: re.Match) -> str:
        made = assets.url(m["ref"].strip(), "application/octet-stream")
        return f'url("{made}")' if made else m[0]

    return _CSS_URL.sub(put, _CSS_IMPORT.sub(imported, css))


def inline_styles(root: Node, assets: Assets) -> int:
    """Linked style sheets with an asset become style elements, and styles get their assets; returns how many links."""
    done = 0
    for n in root.walk():
        if n.tag == "link" and "stylesheet" in n.attrs.get("rel", "").lower() and n.attrs.get("href", "") in assets.files:
            sheet = inline_css(assets.files[n.attrs["href"]].decode("utf-8", "replace"), assets)
            n.tag, n.attrs, n.children = "style", {"data-source": n.attrs["href"]}, [Node(text=sheet)]
            done += 1
        elif n.tag == "style":
            for c in n.children:
                c.text = inline_css(c.text, assets)
        if "url(" in n.attrs.get("style", ""):
            n.attrs["style"] = inline_css(n.attrs["style"], assets)
    return done


def rename_assets(root: Node, names: dict[str, str]) -> int:
    """References to assets get other names (such as those in a package); returns how many."""
    done = 0
    for n in root.walk():
        for key in ("src", "href", "poster"):
            if n.attrs.get(key) in names:
                n.attrs[key] = names[n.attrs[key]]
                done += 1
        if n.attrs.get("srcset"):
            entries = [e.split() for e in re.split(r",\s+", n.attrs["srcset"].strip()) if e.split()]
            done += sum(e[0] in names for e in entries)
            n.attrs["srcset"] = ", ".join(" ".join([names.get(e[0], e[0]), *e[1:]]) for e in entries)
    return done


#: Repairs by name, in the order in which they go over a page.
REPAIRS: dict[str, Callable[[Node], object]] = {"references": link_references, "blocks": lift_blocks, "images": frame_images, "equations": centre_equations}


def _shown(root: Node) -> str:
    """The page; style sheets are not escaped."""
    text = render(root)
    return re.sub(r"(<style\b[^>]*>)(.*?)(</style>)", lambda m: m[1] + html.unescape(m[2]) + m[3], text, flags=re.DOTALL | re.IGNORECASE)


def repair(page: str) -> str:
    root = parse(page)
    for one in REPAIRS.values():
        one(root)
    return _shown(root)


def embed(page: str, files: dict[str, bytes], most: int = IMAGE_BYTES, total: int = TOTAL_BYTES) -> tuple[str, int]:
    """A page with its images and style sheets put in, and how many."""
    root, assets = parse(page), Assets(files, most, total)
    done = inline_images(root, assets) + inline_styles(root, assets)
    return _shown(root), done


@pandas_udf(T.StringType())
def repaired(page: pd.Series) -> pd.Series:
    return page.map(lambda p: repair(p or ""))


_EMBEDDED = T.StructType([T.StructField("html", T.StringType()), T.StructField("inlined", T.LongType())])


def embedded(pages: DataFrame, assets: DataFrame, key: str, html_col: str = "html", most: int = IMAGE_BYTES, total: int = TOTAL_BYTES) -> DataFrame:
    """Pages with html and inlined, their assets put in; `assets` holds key, path and content.

    Assets over the limit of one are left out before they are brought together, so what meets in a row is a
    page's own small files.
    """
    small = assets.filter(F.octet_length("content") <= most).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "content")))).alias("_files"))

    @pandas_udf(_EMBEDDED)
    def run(page: pd.Series, files: pd.Series) -> pd.DataFrame:
        made = [embed(p or "", {k: bytes(v) for k, v in (dict(f) if f is not None else {}).items()}, most, total) for p, f in zip(page, files)]
        return pd.DataFrame(made, columns=["html", "inlined"])

    rows = pages.join(small, key, "left").withColumn("_made", run(F.col(html_col), F.col("_files")))
    return rows.select(*[c for c in pages.columns if c != html_col], "_made.html", "_made.inlined")

"""Main text of HTML pages by two passes of block rules.

A linear tokenizer walks the page once, keeping the stack of open elements with HTML's implied ends.
Containers that are never article text (navigation, forms, adverts, comments, scripts and the like, by
element, role or class words) are left out, and what remains is cut into blocks.  The first pass
labels each block by its length, link density and stop-word density: good, bad, near-good or short.
In the second pass the ambiguous blocks (near-good and short) take the label of their nearest decided
neighbours.  Where a page marks its article, only blocks inside it can be good.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that for with on as by it was are be this from an or which not have at but they his her had were been their has "
    "der die das und in von zu den mit ist im nicht ein eine auf für dem sich des als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec aux ou son "
    "el los las y que en un una por con para su se del al es lo como más o pero sus le ya este no fue".split()
)
# Elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg canvas object audio video select annotation annotation-xml".split())
DROPPED = frozenset("head nav footer aside form menu dialog button fieldset datalist map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot td th".split())
#: Elements that hold paragraphs of their own, so a block in them ends none outside.
HOLDERS = frozenset("td th table button article section div li".split())
GROUPS_OF = {
    name: tuple(group for group, names in (("/block", BLOCK), ("/cell", ("td", "th")), ("/holder", HOLDERS)) if name in names) for name in BLOCK | HOLDERS
}
#: Start tags of these end an open element of the listed names, up to the listed container.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
# Words in class and id that mark containers outside the article.
CLASS_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist disqus respond "
    "replies share sharing social related recommended recommendations popup modal overlay toolbar widget pagination pager login search skip copyright".split()
)
#: Parts of a class or id that make it tell the state of a container, not what it is ("has-sidebar").
STATE_WORDS = frozenset("has have had no not non with without is are open opened closed enabled disabled allowed active inactive on off hide show fixed sticky".split())
#: Class words of containers that may hold more text than the article; length does not spare them.
DISCUSSION_WORDS = frozenset("comment comments commentlist disqus respond replies related recommended recommendations".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
ARTICLE_WORDS = frozenset("articlebody".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLASS_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
#: More than this share of the article's text (of all text, where no article is marked) is its bulk.
BULK = 0.5
_BREAK = "\n"  # in a block's parts: one <br>; a second one ends the block

SHORT_LENGTH, LONG_LENGTH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINK_MOST, LINK_MOST_IN_ARTICLE = 0.2, 0.5
#: A page is in a language of STOP_WORDS if blocks with so many of them hold this share of its long blocks' text.
COVERED = 0.1
#: Characters of scripts without spaces, which count as three each, and letters of the scripts of STOP_WORDS.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")


class Block(NamedTuple):
    """One block of a page: its text, the share of it inside links, and where it stands."""

    text: str
    link_chars: int
    heading: bool
    in_article: bool


class _Element(NamedTuple):
    name: str
    dropped: bool
    headings_only: bool
    in_article: bool
    link: bool
    heading: bool
    hard: bool  # dropped whatever it holds
    at: int  # place of a start tag that class or id mark, else -1


def _tag_end(page: str, at: int) -> int:
    """Place behind the `>` that ends a tag; a quote only counts behind an equals sign."""
    while True:
        found = _STOP.search(page, at)
        if found is None:
            return len(page)
        if found[0] == ">":
            return found.end()
        at = found.end()
        if page[: found.start()].endswith("=") if found.start() < 2 else page[found.start() - 1] == "=" or page[max(0, found.start() - 8) : found.start()].rstrip().endswith("="):
            close = page.find(found[0], at)
            if close < 0:  # no closing quote: the tag ends at the next `>`
                end = page.find(">", at)
                return len(page) if end < 0 else end + 1
            at = close + 1


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _class_words(names: str) -> set[str]:
    """First and last words of the class tokens that tell what a container is."""
    words: set[str] = set()
    for token in names.split():
        parts = [w.lower() for w in _CLASS_SPLIT.split(token) if w]
        if parts and STATE_WORDS.isdisjoint(parts):
            words |= {parts[0], parts[-1], token.lower()}
    return words


def _marks(name: str, raw: str) -> tuple[bool, bool, bool, set[str]]:
    """Whether a start tag marks a dropped container, a page header, or the article; and its class words."""
    drop, header, article = name in DROPPED, name == "header", name in ("article", "main")
    words: set[str] = set()
    if raw and not raw.isspace() and name not in ("body", "html"):
        attrs = _attributes(raw)
        words = _class_words(f"{attrs.get('class', '')} {attrs.get('id', '')}") & (CLASS_WORDS | HEADER_WORDS)
        role = attrs.get("role", "").lower()
        drop = drop or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
        drop = drop or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        article = article or role in ("main", "article") or attrs.get("itemprop", "").lower() in ARTICLE_WORDS
    return drop, header, article, words


def blocks(page: str) -> list[Block]:
    """The blocks of a page outside dropped containers, in page order.

    A container that its class or id marks is kept all the same if it holds the bulk of the article (of
    the page, where no article is marked): then the page is read once more without these marks.
    """
    out, spared = _blocks(page, frozenset())
    return _blocks(page, spared)[0] if spared else out


def _blocks(page: str, spare: frozenset[int]) -> tuple[list[Block], frozenset[int]]:
    """The blocks, and the places of marked start tags whose elements hold the bulk of the text.

    Marks at the places in `spare` do not count.
    """
    out: list[Block] = []
    stack: list[_Element] = [_Element("", False, False, False, False, False, False, -1)]
    # Characters outside hard-dropped elements, of these in an article, and unmarked articles, so far.
    seen, in_article, articles = 0, 0, 0
    opened: dict[int, tuple[int, int, int, bool]] = {}
    held: list[tuple[int, int, int]] = []
    parts: list[str] = []
    linked = 0
    state = {"heading": False}
    depths: dict[str, list[int]] = {}  # of the open elements, by name and group: no search through the stack

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, state["heading"], stack[-1].in_article))
            parts.clear()
        linked = 0

    def measure(depth: int) -> None:
        for e in stack[depth:]:
            if e.at in opened:
                text, article, count, must_hold = opened.pop(e.at)
                if articles > count or not must_hold:
                    held.append((e.at, seen - text, in_article - article))

    def close(depth: int) -> None:
        measure(depth)
        if any(e.name in BLOCK for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            for group in (e.name, *GROUPS_OF.get(e.name, ())):
                depths[group].pop()
        del stack[depth:]

    def last(group: str) -> int:
        """The depth of the innermost open element of a name or group; 0 if none is open."""
        return depths[group][-1] if depths.get(group) else 0

    at, size, raw_open = 0, len(page), {}
    while at < size:
        top = stack[-1]
        lt = page.find("<", at)
        text = page[at:] if lt < 0 else page[at:lt]
        if not top.hard and text and not text.isspace():
            seen += len(text)
            in_article += len(text) if top.in_article else 0
        if text and not top.dropped:
            if not top.headings_only or top.heading:
                if not text.isspace():
                    decoded = html.unescape(text) if "&" in text else text
                    state["heading"] = top.heading
                    if top.link:
                        linked += len(" ".join(decoded.split()))
                    parts.append(decoded)
                elif parts:
                    parts.append(" ")
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        named = _NAME.match(page, lt)
        if named is None:  # a lone "<" is text
            if page.startswith("</", lt):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                if not top.dropped and not top.headings_only:
                    parts.append("<")
                at = lt + 1
            continue
        name = named[1].lower()
        at = _tag_end(page, named.end())
        if page[lt + 1] == "/":
            if name == "br" and parts:
                parts.append(" ")
            # A stray end tag does not reach past a block or out of a cell.
            barrier = max(last("/block") if name not in BLOCK else 0, last("/cell") if name not in TABLE_PARTS else 0)
            if (depth := last(name)) and depth >= barrier:
                close(depth)
            continue
        if name in RAW_TEXT:
            if page[at - 2 : at] == "/>" and name in ("svg", "math"):
                continue
            if raw_open.get(name) != -1:
                end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                if end is None and name not in ("script", "style", "title", "textarea"):
                    raw_open[name] = -1
                    continue
                at = size if end is None else _tag_end(page, end.end())
            continue
        if name == "br":
            if parts:
                if parts[-1] is _BREAK:
                    flush()
                else:
                    parts.append(_BREAK)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            flush()
            if last("p") > last("/holder"):  # a block ends an open paragraph
                close(last("p"))
        if name in IMPLIED_END:
            ends, until = IMPLIED_END[name]
            container = max(map(last, until))
            open_ends = [group[i] for group in (depths.get(e, []) for e in ends) if (i := bisect_right(group, container)) < len(group)]
            if open_ends:
                close(min(open_ends))
        elif name in HEADINGS and stack[-1].name in HEADINGS:
            close(len(stack) - 1)
        elif name == "body" and last("head"):
            close(depths["head"][0])
        if page[at - 2 : at] == "/>" and name not in BLOCK and name != "a":
            continue
        top = stack[-1]
        drop, header, article, words = _marks(name, page[named.end() : at - 1])
        inside, hard = top.in_article or article, top.hard or drop or header and not top.in_article
        marked = bool(words) and not hard
        if marked:
            opened[lt] = seen, in_article, articles, not article and not words.isdisjoint(DISCUSSION_WORDS)
        elif article and not hard:
            articles += 1
        if marked and lt not in spare:
            drop = drop or not words.isdisjoint(CLASS_WORDS)
            header = header or not words.isdisjoint(HEADER_WORDS)
        dropped = top.dropped or drop or header and not top.in_article
        for group in (name, *GROUPS_OF.get(name, ())):
            depths.setdefault(group, []).append(len(stack))
        stack.append(_Element(name, dropped, top.headings_only or header and top.in_article, inside, top.link or name == "a", top.heading or name in HEADINGS, hard, lt if marked else -1))
    flush()
    measure(0)
    bulk = BULK * (in_article or seen)
    return out, frozenset(place for place, text, article in held if (article if in_article else text) > bulk)


def _length(text: str) -> int:
    """Characters of a text; those of scripts without spaces count more, as they say more."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _density(text: str, stop_words: frozenset[str]) -> float:
    """Share of stop words; -1 for a text of which most letters are of other scripts."""
    if not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(str.isalpha, text)):
        return -1.0
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in stop_words for w in words) / len(words)


def first_labels(found: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[str]:
    """Pass one: good, bad, near or short for each block, by itself.

    Stop words say nothing about other scripts and languages: blocks in another script, and all blocks of
    a page where hardly any reaches the density, go by length and link density alone.
    """
    has_article = any(b.in_article for b in found)
    labels = []
    densities: dict[int, float] = {}
    for i, b in enumerate(found):
        length, links = _length(b.text), b.link_chars / len(b.text)
        if has_article and not b.in_article or "©" in b.text and length < LONG_LENGTH:
            labels.append("bad")
        elif links > (LINK_MOST_IN_ARTICLE if b.in_article else LINK_MOST):
            labels.append("bad")
        elif b.heading or length < SHORT_LENGTH:
            labels.append("bad" if b.link_chars and not b.in_article else "short")
        else:
            densities[i] = _density(b.text, stop_words)
            labels.append("")
    total = sum(len(found[i].text) for i, d in densities.items() if d >= 0)
    covered = sum(len(found[i].text) for i, d in densities.items() if d >= STOP_LOW) >= COVERED * total
    for i, density in densities.items():
        b, length = found[i], _length(found[i].text)
        if density >= STOP_HIGH:
            labels[i] = "good" if length > LONG_LENGTH or b.in_article else "near"
        elif density >= STOP_LOW or b.in_article:
            labels[i] = "near"
        elif density < 0 or not covered:
            labels[i] = "good" if length > LONG_LENGTH else "near"
        else:
            labels[i] = "bad"
    return labels


def second_labels(found: list[Block], labels: list[str]) -> list[bool]:
    """Pass two: ambiguous blocks take the label of the nearest decided neighbour.

    A heading looks ahead first.  Between two equally near neighbours of unlike label, near-good blocks
    are kept and short ones are not.  If no block of the page is good, near-good blocks are kept, short
    ones inside an article too, and all short ones if there is no near-good block either.
    """
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        if labels[i] in ("good", "bad"):
            last = i
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            last = i
        after[i] = last
    some_good, some_near = "good" in labels, "near" in labels
    kept = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            kept.append(label == "good")
            continue
        lo, hi = before[i], after[i]
        near = [j for j in (lo, hi) if j is not None and (not found[i].in_article or found[j].in_article)]
        if not some_good or not near:
            kept.append(label == "near" or found[i].in_article or not (some_good or some_near))
        elif len({labels[j] for j in near}) == 1:
            kept.append(labels[near[0]] == "good" or label == "near" and found[i].in_article)
        elif found[i].heading:
            kept.append(labels[hi] == "good")
        elif i - lo == hi - i:
            kept.append(label == "near" or found[i].in_article)
        else:
            kept.append(labels[lo if i - lo < hi - i else hi] == "good")
    return kept


def main_text(page: str | None) -> str:
    """The article of a page: its good blocks, one to a line; empty if there is none."""
    found = blocks(page or "")
    kept = second_labels(found, first_labels(found))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns id, url, text, n_chars (code points): one row per input row, repeated rows included.  Null and
    empty pages give an empty text; pages of any length are read whole, in time linear in their length.
    Other columns are left out, whatever their names.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        columns = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_arrow(chosen, rows, f"`{id_col}` {kind}, url string, text string, n_chars long")

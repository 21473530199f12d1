"""Main text of web pages: structure first, then removal of each site's templates.

A page is read into its element tree by a tolerant scanner (unclosed paragraphs and list
items are closed by the next one, stray end tags are ignored, a page may break off anywhere).
Tags and attributes are read as the HTML standard's tokenizer does. The main part is the
outermost ``article`` (else ``main``, else ``body``). Elements that are furniture by name, role
or class are left out.

Element subtrees are hashed bottom-up, counted for each host and left out where they recur on
many of its pages:

* where a page names no main part, on a share of those of the host that name none, or of all,
  where what lies outside an article (or main) counts;
* inside an article or main, blocks other than running text (paragraphs, headings, quotations,
  tables, figures) that recur on a share of all pages of the host, where pages whose main texts
  have the same smallest shingle hash count once (the most by PRINTS mixes of the hashes). Copies
  of an article make no template of its parts, and a sentence that many articles share stays.

Cases: a null or empty page has the text ""; a null url counts as the host ""; repeated rows
count as pages of their own (inside articles once) and give a row each; an empty table gives an empty result; other
columns are ignored. Whole pages are read.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, grams, mix, run_hashes, settle, slices, words

VALUE = r"""(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)"""
NAME = r"[^\s/>][^\s/>=]*+"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + NAME + r"(?:\s*+=\s*+" + VALUE + r"?+)?+)*+)(?:>|\Z)|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>", re.S
)
ATTRIBUTE = re.compile(f"({NAME})(?:\\s*+=\\s*+({VALUE})?+)?+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
GONE = {"head", "script", "style", "nav", "footer", "aside", "form", "button", "select", "input", "textarea", "iframe", "noscript", "template", "svg", "dialog", "menu", "object", "canvas", "title"}
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: What else a class or id may be made of that names furniture: ``site-footer`` is such, ``social-science`` isn't.
AROUND = {
    "area", "articles", "back", "bar", "block", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "content", "cta", "dropdown", "fixed", "form", "global", "group", "header", "icon", "icons", "inline",
    "inner", "item", "items", "js", "label", "left", "link", "links", "list", "main", "media", "message", "mobile", "module", "news", "outer", "overlay", "page", "panel", "post", "posts", "primary", "region", "right", "row",
    "secondary", "section", "sidebar", "site", "slot", "small", "sticky", "stories", "tab", "text", "title", "toggle", "top", "unit", "wide", "wrap", "wrapper",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = {"article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"div", "article", "section", "td", "th", "li", "body", "main", "aside", "footer", "header", "nav", "blockquote", "table"}, "option": {"select"}}

#: A subtree belongs to the template if it is on at least so many pages of its host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 8, 0.3
#: Running text: never a template inside a named main part.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tbody", "thead", "tr", "td", "th", "figure", "figcaption", "br", "hr", "dt", "dd", "li"}
#: Templates are sent to all executors if there are at most so many, and joined by host otherwise.
BROADCAST_ROWS = 50_000
#: Smallest hashes of a main text.
PRINTS = 4
#: Stands for the page itself among the hashes of its subtrees, which are not negative.
PAGE = -1


class Element:
    __slots__ = ("tag", "parent", "attributes", "gone", "parts", "key")

    def __init__(self, tag: str, parent: Element | None, attributes: str, gone: bool):
        self.tag, self.parent, self.attributes, self.gone, self.parts, self.key = tag, parent, attributes, gone, [], 0


def named_furniture(name: str) -> bool:
    """Whether a class or id names furniture: all its parts do, or surround one that does."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
    return not FURNITURE.isdisjoint(parts) and all(x in FURNITURE or x in AROUND for x in parts)


def furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in GONE or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and any(map(named_furniture, value.split())):
            return True
        if (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def parse(page: str) -> Element:
    """The tree of a page. parts holds text and elements in order."""
    root = Element("#", None, "", False)
    top, at, articles, n = root, 0, 0, len(page)
    opened: Counter = Counter()  # how many elements of each tag are open
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            top.parts.append(page[at:])
            break
        if m.start() > at:
            top.parts.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if not page[at - 1 : at] == ">":
            break  # the page breaks off inside a tag
        if m.group(1):
            while opened[tag]:
                opened[top.tag] -= 1
                articles -= top.tag in ("article", "main")
                done, top = top.tag, top.parent
                if done == tag:
                    break
            continue
        for closed in ((CLOSES[tag], SCOPE[tag]),) if tag in CLOSES else (({"p"}, SCOPE["p"]),) if tag in BREAKS_P else ():
            x = top if any(opened[t] for t in closed[0]) else root
            while x is not root and x.tag not in closed[0] and x.tag not in closed[1]:
                x = x.parent
            if x.tag in closed[0]:
                while top is not x.parent:
                    opened[top.tag] -= 1
                    articles -= top.tag in ("article", "main")
                    top = top.parent
        element = Element(tag, top, m.group(3), furniture(tag, m.group(3), articles > 0))
        top.parts.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            element.parts.append(page[at : close.start() if close else n])
            at = close.end() if close else n
            continue
        top = element
        opened[tag] += 1
        articles += tag in ("article", "main")
    return root


def set_keys(root: Element) -> None:
    """Give every element a 63-bit hash of its tag, attributes, texts and the hashes of its elements."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [y for y in x.parts if isinstance(y, Element)]
    for x in reversed(order):
        own = hashlib.blake2b(f"{x.tag} {' '.join(x.attributes.split())}".encode("utf-8", "replace"), digest_size=8)
        for y in x.parts:
            if isinstance(y, Element):
                own.update(b"\0e" + y.key.to_bytes(8, "big"))
            elif words := y.split():
                own.update(b"\0t" + " ".join(words).encode("utf-8", "replace"))
        x.key = int.from_bytes(own.digest(), "big") >> 1


def _first(x: Element, tag: str) -> list[Element]:
    """The outermost elements of a tag that are not furniture."""
    out, stack = [], [x]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            out.append(x)
        elif not x.gone:
            stack += [y for y in reversed(x.parts) if isinstance(y, Element)]
    return out


def main_parts(root: Element) -> tuple[list[Element], bool]:
    """(the elements that hold the main text, whether the page names them)."""
    for tag in ("article", "main"):
        if found := _first(root, tag):
            return found, True
    return _first(root, "body") or [root], False


def text_of(page: str, outer: set[int] = frozenset(), inner: set[int] = frozenset()) -> str:
    """The main text without the subtrees of outer, or, if the page names its main part, without those of inner."""
    root = parse(page)
    parts, named = main_parts(root)
    template = inner if named else outer
    if template:
        set_keys(root)
    return _text(parts, named, template)


def _text(parts: list[Element], named: bool, template: set[int]) -> str:
    out: list[str] = []
    stack: list = list(reversed(parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.gone and not (template and _counts(x, named) and x.key in template):
            space = x.tag not in INLINE
            if space:
                out.append(" ")
                stack.append(" ")
            stack += reversed(x.parts)
    return " ".join(references.unescape("".join(out)).split())


def _counts(x: Element, inner: bool) -> bool:
    """Whether an element can be a template."""
    return x.tag not in INLINE and x.tag not in ("body", "#", "article", "main") and not (inner and x.tag in PROSE)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def fingerprints(texts: list[str]) -> np.ndarray:
    """The smallest hashes, by PRINTS mixes, of three words in a row of each text, of all its words if there are fewer; a row for each text."""
    data, at = buffers(pa.array(texts, pa.string()))
    starts, ends, first = words(data, at)
    g, i = grams(run_hashes(data, starts, ends), first, 3)
    low, owner = np.full((len(texts), PRINTS), 2**63 - 1, np.int64), np.searchsorted(first, i, "right") - 1
    for k in range(PRINTS):
        np.minimum.at(low[:, k], owner, (mix(g + np.uint64(k)) >> np.uint64(1)).astype(np.int64))
    for t in np.flatnonzero(np.diff(first) < 3).tolist():
        low[t] = int.from_bytes(hashlib.blake2b(texts[t].encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1
    return low


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, subtree, own, inner, mixed, print): the distinct hashes of block elements of each page, and PAGE once.

    own where the page names no main part, inner for elements inside a named one; those have a row for each print of the main text.
    """

    def listed(batches):
        for batch in batches:
            for part in slices(batch):
                rows, texts = [], []
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    root = parse(page or "")
                    set_keys(root)
                    found, named = main_parts(root)
                    texts.append(_text(found, named, frozenset()))
                    within, around = {id(x) for x in found} if named else set(), set()
                    for x in found if named else ():
                        while (x := x.parent) is not None and id(x) not in around:
                            around.add(id(x))
                    seen, stack = {(PAGE, False)}, [(x, False) for x in ((_first(root, "body") or [root]) if named else found)]
                    while stack:
                        x, inner = stack.pop()
                        inner |= id(x) in within
                        if _counts(x, inner) and id(x) not in around:
                            seen.add((x.key, inner))
                        stack += [(y, inner) for y in x.parts if isinstance(y, Element) and not y.gone]
                    rows += [(host, key, not named, inner, len(texts) - 1) for key, inner in sorted(seen)]
                prints = fingerprints(texts)
                rows = [(*r[:4], k, int(prints[r[4], k]) if r[3] else 0) for r in rows for k in range(PRINTS if r[3] else 1)]
                types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["host", "subtree", "own", "inner", "mixed", "print"])

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(listed, "host string, subtree long, own boolean, inner boolean, mixed int, print long")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, subtree, inner): what recurs on many pages of a host, outside and inside named main parts."""
    by_print = subtrees(pages).groupBy("host", "subtree", "inner", "mixed", "print").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"))
    by_mix = by_print.groupBy("host", "subtree", "inner", "mixed").agg(F.sum("n").alias("n"), F.sum("n_own").alias("n_own"), F.count("*").alias("prints"))
    counts = by_mix.groupBy("host", "subtree", "inner").agg(F.max("n").alias("n"), F.max("n_own").alias("n_own"), F.max("prints").alias("prints"))
    counts = settle(counts.where((F.col("n") >= least_pages) | (F.col("subtree") == PAGE)))
    sizes = counts.where(F.col("subtree") == PAGE).select("host", F.col("n").alias("pages"), F.col("n_own").alias("pages_own"))
    outer = (F.col("n") >= least_share * F.col("pages")) | ((F.col("n_own") >= least_pages) & (F.col("n_own") >= least_share * F.col("pages_own")))
    inner = (F.col("prints") >= least_pages) & (F.col("prints") >= least_share * F.col("pages"))
    often = F.when(F.col("inner"), inner).otherwise((F.col("pages_own") > 0) & outer)
    return counts.where(F.col("subtree") != PAGE).join(sizes, "host").where(often).select("host", "subtree", "inner")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    known = settle(templates(pages, least_pages, least_share))
    # A host has at most 3 * (subtrees of a page) / least_share of them, so its lists are bounded.
    subtree = F.col("subtree")
    lists = settle(known.groupBy("host").agg(F.collect_set(F.when(~F.col("inner"), subtree)).alias("outer"), F.collect_set(F.when(F.col("inner"), subtree)).alias("inner")))
    small = known.count() <= BROADCAST_ROWS
    joined = pages.select("page_id", "html", "url", host_of("url").alias("host")).join(F.broadcast(lists) if small else lists, "host", "left").select("page_id", "html", "url", "outer", "inner")

    def extracted(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [text_of(page or "", frozenset(o or ()), frozenset(i or ())) for page, o, i in zip(*(part.column(k).to_pylist() for k in (1, 3, 4)))]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block of the page.  What cannot be main text by its element, its role or a class or id that names nothing but
boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) leaves a gap of empty lines, and so do the borders of an
article.  Lines that are mostly links count as empty.  Text lengths are summed over sliding windows of lines.  The text surges where a window passes the threshold
and dives where windows are empty; if no window passes the threshold, the largest one takes its place.  This decides on every page:

* where the page marks articles, those in which the text surges are kept; the marks move the borders of the text to theirs, so all of their lines stay.
* else the text runs from the first to the last surge, with what stands between them, and with headings and paragraphs before and after that are children of the same
  element as a line that surges.

Open elements are kept on a stack, with the end tags that HTML lets one omit: an item, cell, option or paragraph ends with its next sibling or with its parent.
What is left out ends with its element, also where that is not closed.

Inside a marked article a class or id must name boilerplate as a whole, by a word that has no other use; "discussion", "side-effects" or "legal" stay.

Character references are decoded once, white space in a block becomes one space, blocks are joined by a newline.  A null html counts as
empty; an empty page, or one without text, gives the empty text.  Repeated rows are extracted alike; very long pages are read whole.  An empty table gives an empty
result.  Other columns are left as they are.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocohort.llm.base import small_batches

WINDOW = 3
#: Elements that may be open one inside the other; deeper ones are not told apart from their parents.
DEEPEST = 1000
SURGE = 86

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*>""", re.S)
#: What stands between the name of a tag and the value of its next attribute, or the end of it.
PLAIN = re.compile(r"""(?:[^=>]++|=\s*+[^\s"'>][^\s>]*+|=\s*+(?=>))*+(?:>|=\s*+(["']))""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HINT = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)

#: Elements whose content is no markup.
RAW = {"script", "style", "noscript", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Elements that never hold main text.
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "template", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar", "tablist"}
#: Words in class and id that name what is no main text; those of the first set mean nothing else.
SURE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "gdpr",
        "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "trending", "pagination", "pager", "toolbar", "copyright"}
OTHERS = {"side", "notice", "login", "discussion", "replies", "banner", "promotion", "widget", "skip", "legal", "disclaimer", "alert"}
#: Words that may stand beside them.
NEUTRAL = {"container", "wrapper", "wrap", "box", "block", "list", "section", "bar", "top", "bottom", "left", "right", "item", "items", "unit", "slot", "inner", "outer", "area", "button", "buttons", "link", "links", "form", "header", "text",
           "message", "policy", "site", "page", "primary", "secondary", "global", "mobile", "desktop", "sticky", "inline", "media", "posts", "articles", "stories", "content", "panel", "group", "icons", "main", "col", "column", "thread", "reader", "user"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks of running text.
PROSE = HEADINGS | {"p", "blockquote", "pre", "li", "dd", "dt"}
BLOCKS = HEADINGS | MAIN | {"p", "div", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "section", "header", "footer", "nav", "aside", "blockquote", "pre", "address", "hr", "figure", "figcaption", "details", "summary", "body", "html", "center", "hgroup"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


def _boilerplate(token: str, inside: bool) -> bool:
    """Whether one class or id, as a whole, names what is no main text."""
    parts = [w for w in re.split(r"[-_\d]+", token) if w]
    sure = SURE if inside else SURE | OTHERS
    return any(w in sure for w in parts) and all(w in SURE or w in OTHERS or w in NEUTRAL for w in parts)


def _named_off(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether the attributes of an element say that it holds no main text; ``inside``: within a marked article."""
    if name in ("html", "body") or name in MAIN or not HINT.search(attributes):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
        if key in ("class", "id") and any(_boilerplate(token, inside) for token in value.split()):
            return True
    return False


def _end(page: str, at: int, failed: set[int]) -> int:
    """Where the tag whose name ends at ``at`` ends: after the first > outside of quoted values, however long; if a quote is never closed,
    after the first > of all; -1 without one.  ``failed`` holds the places of values from which no end was found, so that all calls for a
    page take time in proportion to it."""
    tried, here = [], at
    while (m := PLAIN.match(page, here)) and here not in failed:
        if not m[1]:
            return m.end()
        tried.append(here)
        here = page.find(m[1], m.end()) + 1
        if not here:
            break
    failed.update(tried)
    return page.find(">", at) + 1 or -1


#: A start tag of the first ends open elements of the second, looked for up to one of the third.
_CELLS, _ROWS = {"td", "th"}, {"tr", "td", "th"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
        "td": (_CELLS, {"table"}), "th": (_CELLS, {"table"}), "tr": (_ROWS, {"table"}), **{x: (_ROWS | {"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")}}
#: An open paragraph ends with any block; it is looked for up to one of these.
PARAGRAPH_IN = {"td", "th", "caption", "table", "button", "object", "html"}


@dataclass(frozen=True)
class Line:
    """A block's text, the characters of it in links, its element and that one's parent (numbers of open elements), and the outermost article around it (0: none)."""

    text: str
    links: int = 0
    name: str = ""
    parent: int = 0
    article: int = 0


def lines(page: str) -> list[Line]:
    """The blocks of a page; gaps are empty lines."""
    out: list[Line] = []
    held: list[str] = []
    linked = number = 0
    open_: list[tuple[str, int]] = []  # elements, each with its number
    skip = -1  # place on the stack of the element that is left out
    articles: list[int] = []  # places of open articles
    in_link = False

    def close(gap: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        article = open_[articles[0]][1] if articles else 0
        if text:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in BLOCKS), -1)
            name, up = (open_[at][0], open_[at - 1][1] if at > 0 else 0) if at >= 0 else ("", 0)
            out.append(Line(text, min(linked, len(text)), name, up, article))
        held.clear()
        linked = 0
        if gap:
            out.extend([Line("", article=article)] * (WINDOW + 1))

    def keep(piece: str) -> None:
        nonlocal linked
        if piece and skip < 0:
            decoded = markup.unescape(piece)
            held.append(decoded)
            if in_link:
                linked += len(decoded.strip())

    def cut(to: int) -> None:
        """Close all open elements from place ``to`` on."""
        nonlocal skip, in_link
        if any(name in BLOCKS or name in ASIDE for name, _ in open_[to:]) and skip < 0:
            close()
            in_link = False
        while articles and articles[-1] >= to:
            if skip < 0:
                close(gap=True)
            articles.pop()
        del open_[to:]
        if skip >= to:
            skip = -1

    def last(names: set[str], up_to: set[str]) -> int:
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in names:
                return i
            if open_[i][0] in up_to:
                return -1
        return -1

    at, failed = 0, set()
    while m := TAG.search(page, at):
        end = _end(page, m.end(), failed) if m[2] else m.end()
        if end < 0:  # no > is left
            break
        keep(page[at : m.start()])
        at = end
        if not m[2]:
            continue
        attributes = page[m.end() : at - 1]
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if closing:
            if name == "a" and skip < 0:
                in_link = False
            if (place := last({name}, set() if name not in ENDS else ENDS[name][1])) >= 0:
                cut(place)
            continue
        if name in BLOCKS and (place := last({"p"}, PARAGRAPH_IN)) >= 0:
            cut(place)
        if name in ENDS:
            while (place := last(*ENDS[name])) >= 0:
                cut(place)
        if name in MAIN and skip >= 0:  # what was left out is taken to have ended
            cut(skip)
        if name in VOID:
            if name == "hr" and skip < 0:
                close()
            continue
        number += 1
        if skip < 0:
            if name in MAIN:
                close(gap=not articles)
                articles.append(len(open_))
            elif name in ASIDE or name == "header" and not articles or _named_off(name, attributes, bool(articles)):
                close(gap=True)
                skip = len(open_)
            elif name == "a":
                in_link = True
            elif name in BLOCKS:
                close()
                in_link = False
        if len(open_) < DEEPEST:
            open_.append((name, number))
    keep(page[at:])
    close()
    return out


def regions(sizes: list[int], surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, stop) of the lines between the dives around each surge."""
    if not any(sizes):
        return []
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    windows = [total[min(i + WINDOW, len(sizes))] - total[i] for i in range(len(sizes))]
    bar = min(surge, max(windows))
    out, at = [], 0
    while at < len(sizes):
        if not sizes[at]:
            at += 1
            continue
        stop = at
        while stop < len(sizes) and windows[stop]:  # an empty window: the text dives
            stop += 1
        if max(windows[at:stop]) >= bar:
            out.append((at, stop))
        at = stop
    return out


def extract(page: str) -> str:
    """The main text of one page."""
    found = lines(page)
    marked = any(x.text and x.article for x in found)
    sizes = [0 if 2 * x.links > len(x.text) or marked and not x.article else len(x.text) for x in found]
    surges = [i for first, stop in regions(sizes) for i in range(first, stop)]
    if marked:
        kept = {found[i].article for i in surges} or {x.article for x in found if x.text and x.article}
        return "\n".join(x.text for x in found if x.text and x.article in kept and x.article)
    if not surges:
        return ""
    parents = {found[i].parent for i in surges if sizes[i]}
    inside = range(surges[0], surges[-1] + 1)
    return "\n".join(x.text for i, x in enumerate(found) if sizes[i] and (i in inside or x.name in PROSE and x.parent in parents))


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([extract(x.as_py() or "") for x in pages], pa.string())


def main_text(spark: SparkSession, html: str = "html") -> Column:
    """The main text of a column of pages."""
    small_batches(spark)
    return _extract(F.col(html).cast("string"))

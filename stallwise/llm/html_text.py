"""Main text of web pages by composite text density.

Every element gets its characters per tag, adjusted for links: much text outside links counts
more, text inside links less. The element whose children's densities sum up highest is the
core of the page, and the least density on its path to the body is the threshold: every
subtree from the body down whose density reaches it gives its own best-summed element. What
lies outside these elements, and furniture inside them, is left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

OPENS = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
COMMENT_END = re.compile(r"--!?>")
TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul caption".split()
)
FURNITURE = frozenset(
    "head nav footer aside form script style noscript iframe object template svg canvas button select option input"
    " textarea dialog menu title noembed noframes audio video map".split()
)
#: An open element of the left kind ends where one of the right begins, unless a boundary lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
#: What may stand in a head; anything else ends it.
HEAD_CONTENT = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
#: Inside furniture, elements that the closing tag of an element around them does not end.
SCOPES = frozenset("table caption td th object template svg".split())
#: Words that name furniture in a class, an id or a role.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar nav navbar"
    " navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup share sharing social related recommended comment comments"
    " commentlist disqus replies respond pagination pager toolbar widget widgets search login skip-link complementary"
    " contentinfo dialog".split()
)
CORE_WORDS = frozenset(["article", "main", "content", "post", "entry", "story"])


class Markup:
    """The tags of a page one after the other, in time that grows with its length alone.

    A ``<`` without an end that counts is text. Quotes hide a ``>``. Where one tag turns out to
    have no end, the ends of all others are worked out from the back in one pass, so that
    none is searched for twice.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def work_out(self) -> None:
        """For every ``>`` and quote, where a tag ends that gets there outside of quotes; -1 for never."""
        self.places = [m.start() for m in re.finditer("[>\"']", self.page)]
        self.ends = [-1] * (len(self.places) + 1)
        following = {'"': len(self.places), "'": len(self.places)}
        for i in range(len(self.places) - 1, -1, -1):
            sign = self.page[self.places[i]]
            if sign == ">":
                self.ends[i] = self.places[i] + 1
            else:
                shut, following[sign] = following[sign], i
                self.ends[i] = self.ends[shut + 1] if shut < len(self.places) else -1

    def end_of(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if it does not."""
        if at > self.last:
            return -1
        if self.places is None:
            found = TAG_END.match(self.page, at)
            if found:
                return found.end()
            self.work_out()
        return self.ends[bisect_left(self.places, at)]

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, closing, name, attributes) of the first markup from ``at`` on; no name for comments and the like."""
        while found := OPENS.search(self.page, at):
            at = found.end()
            if found[1]:
                shut = COMMENT_END.search(self.page, at)
                return found.start(), shut.end() if shut else len(self.page), False, None, ""
            if found[4]:
                end = self.page.find(">", at) + 1 if at <= self.last else 0
                if end:
                    return found.start(), end, False, None, ""
            else:
                end = self.end_of(at)
                if end >= 0:
                    return found.start(), end, bool(found[2]), found[3], self.page[at : end - 1]
        return None


class Element:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked", "core", "cut")

    def __init__(self, tag: str, parent: Element | None, core: bool = False, cut: bool = False):
        self.tag, self.parent, self.core, self.cut = tag, parent, core, cut
        self.parts: list[str | Element] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.marked = False


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def words_of(found: dict[str, str]) -> set[str]:
    named = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    whole = set(named.split())
    return whole | {w for x in whole for w in re.split(r"[-_:]+", x)}


def is_furniture(tag: str, text: str, inside_core: bool) -> bool:
    """Whether an element is a menu, an advert or the like; whole names and their parts count."""
    if tag in FURNITURE or tag == "header" and not inside_core:
        return True
    if not text.strip() or tag in ("html", "body", "article", "main"):
        return False
    found = attributes(text)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True
    words = words_of(found)
    return bool(words & FURNITURE_WORDS) and not words & CORE_WORDS


def closed(here: Element, tag: str, opened: Counter) -> Element | None:
    """The open element that a closing tag ends, if any; the root stays open.

    The end of an element around furniture ends the furniture too, but for tables and the like
    in between, and an inline element does not end a block of the furniture.
    """
    if not opened[tag]:
        return None
    walls = frozenset(["table", "template"]) if tag in TABLE_PARTS else SCOPES
    if tag == "li":
        walls = walls | ENDS["li"][1]
    inline = tag not in BLOCKS and tag not in FURNITURE
    node, walled = here, False
    while node.parent is not None:
        if node.tag == tag and not (walled and not node.cut):
            return node
        if node.cut:
            walled = walled or node.tag in walls or inline and node.tag in BLOCKS
        node = node.parent
    return None


def parsed(page: str) -> Element:
    """The tree of a page, furniture left out; unclosed and stray tags do no harm.

    Works without recursion, so that the depth of a page is no limit. Furniture is opened and
    closed like anything else, but hangs on no parent: its elements are ``cut``.
    """
    root = Element("body", None)
    at, here, markup = 0, root, Markup(page)
    opened: Counter[str] = Counter()  # open elements by tag
    core = 0

    def back_to(node: Element) -> None:
        """Ends all open elements inside ``node``."""
        nonlocal here, core
        while here is not node:
            core -= here.core
            opened[here.tag] -= 1
            here = here.parent

    while True:
        found = markup.next(at)
        text = page[at : found[0] if found else len(page)]
        if here.tag == "head" and text.strip():
            back_to(here.parent)
        if text and not here.cut:
            here.parts.append(html.unescape(text) if "&" in text else text)
        if not found:
            return root
        _, at, closing, tag, rest = found
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            node = closed(here, tag, opened)
            if node is not None:
                back_to(node.parent)
            continue
        bare = rest.endswith("/") or tag in VOID
        if tag in RAW and not bare:
            end = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        if here.cut and opened["head"] and (tag == "body" or here.tag == "head" and tag not in HEAD_CONTENT):
            node = here
            while node.tag != "head":
                node = node.parent
            back_to(node.parent)
        if tag == "br" or tag == "wbr":
            if not here.cut:
                here.parts.append(" " if tag == "br" else "")
        elif tag not in ("html", "body") and not bare:
            ends, stops = ENDS.get(tag, (frozenset(), frozenset()))
            if tag in BLOCKS:
                ends, stops = ends | {"p"}, stops | {"table", "button"}
            if any(opened[x] for x in ends):
                node, last = here, None
                while node is not root and node.tag not in stops:
                    if node.tag in ends:
                        last = node
                    elif node.tag in BLOCKS or node.cut and not node.parent.cut:
                        break
                    node = node.parent
                if last is not None:
                    back_to(last.parent)
            opened[tag] += 1
            if here.cut:
                here = Element(tag, here, cut=True)
            elif is_furniture(tag, rest, core > 0):
                if tag in BLOCKS:
                    here.parts.append(Element("hr", here))
                here = Element(tag, here, cut=True)
            else:
                child = Element(tag, here, tag in ("article", "main"))
                core += child.core
                here.parts.append(child)
                here = child
        elif tag == "hr" and not here.cut:
            here.parts.append(Element("hr", here))


def ordered(root: Element) -> list[Element]:
    """All elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    return out


def measure(nodes: list[Element]) -> None:
    """Characters, tags, link characters and tags, density and sum of the children's densities."""
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.tags += node.tags + 1
            node.parent.link_chars += node.link_chars
            node.parent.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if not node.chars:
            continue
        tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        ratio = node.chars / links * tags / link_tags
        # A logarithm to the base of another: text outside links raises it, link text lowers it.
        # Both are moved by a constant, so that a page without links has the base e.
        node.density = node.chars / tags * math.log(ratio + math.e) / math.log(base + math.e - 1)
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density


def marked(nodes: list[Element]) -> list[Element]:
    """The elements that are the page's content, in page order."""
    body = nodes[0]
    peak: dict[int, Element] = {}
    for node in reversed(nodes):
        best = node
        for x in node.parts:
            if not isinstance(x, str) and x.chars and peak[id(x)].total >= best.total:
                best = peak[id(x)]
        peak[id(node)] = best
    top = peak[id(body)]
    threshold, node = body.density, top
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    chosen, stack = [], [body]
    while stack:
        node = stack.pop()
        if node.marked:
            continue
        if node.chars and node.density >= threshold:
            best = peak[id(node)]
            if not best.marked:
                chosen.append(best)
                inner = [best]
                while inner:
                    x = inner.pop()
                    x.marked = True
                    inner.extend(y for y in x.parts if not isinstance(y, str))
            if best is not node:
                stack.extend(x for x in node.parts if not isinstance(x, str))
    return chosen


def lifted(chosen: list[Element], body: Element) -> list[Element]:
    """The article that holds a chosen element instead of it: titles and short paragraphs count."""
    out: dict[int, Element] = {}
    for node in chosen:
        home, at = node, node
        while at is not None:
            if at.core:
                home = at
            at = at.parent
        out[id(home)] = home
    if any(x.core for x in out.values()):
        out = {k: x for k, x in out.items() if x.core}
    return list(out.values()) or [body]


def blocks_of(roots: list[Element], nodes: list[Element]) -> Iterator[str]:
    """The text of each block under ``roots``, in page order, white space made one space."""
    wanted = {id(x) for x in roots}
    text: list[str] = []
    stack: list[tuple[Element | str | None, bool]] = [(nodes[0], id(nodes[0]) in wanted)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            yield " ".join("".join(text).split())
            text = []
        elif isinstance(item, str):
            if inside:
                text.append(item)
        else:
            block = item.tag in BLOCKS
            if block:
                stack.append((None, inside))
            inside = inside or id(item) in wanted
            stack.extend((x, inside) for x in reversed(item.parts))
            if block:
                stack.append((None, inside))
    yield " ".join("".join(text).split())


def main_text(page: str | None) -> str:
    """The main text of an HTML page, blocks joined by an empty line; empty if there is none."""
    nodes = ordered(parsed(page or ""))
    measure(nodes)
    if not nodes[0].chars:
        return ""
    roots = lifted(marked(nodes), nodes[0])
    return "\n\n".join(x for x in blocks_of(roots, nodes) if x)


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    A null or empty page, or one without text, gives the empty text. Other columns are ignored;
    repeated rows are read each.
    """
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    return pages.select("page_id", "url", "html").mapInArrow(reading, schema)

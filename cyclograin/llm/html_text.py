"""Main text of web pages by composite text density.

A tolerant parser builds the DOM of a page; menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are cut out by element, role and name. For every remaining
node the composite density is computed: characters per tag, adjusted for the share of linked
characters and tags. A node's density sum adds up its children's densities; the node with the largest
sum holds the article. The least density on its path up to the body is the threshold: every subtree
that reaches it gives its own node of largest sum, or the whole subtree where it is an article or stands
beside the path. The outermost article on the path is taken whole (without one, the outermost main
element), and of a main element around it the headings, paragraphs and own text too.

Edge cases: null, empty and text-free pages give the empty text; unclosed and misnested tags are
closed where the next block begins or the page ends; nesting of any depth is handled without
recursion. Repeated rows each give a row. Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclograin.llm import textkit

# Element names of the HTML standard by role, and common names of page furniture.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
SCOPE = {"html", "body", "table", "td", "th", "ul", "ol", "dl", "div", "section", "article", "main", "blockquote", "form", "aside", "nav"}
FURNITURE = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "form", "head", "header", "iframe", "input", "menu",
    "nav", "noembed", "noframes", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
ROLES = {
    "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search",
    "status", "toolbar",
}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "alert", "banner",
    "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu",
    "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "paywall", "popup", "promo", "promos", "promotion", "recommended", "related", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: elements of running text: names never cut them
PROSE = HEADINGS | {"p"}
CONTAINERS = {"article", "main"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: what follows one of these in a name says what the page has, not what the element is
_ABOUT = {"has", "with", "no", "without", "is"}
_STATES = {"open", "closed", "enabled", "disabled"}
#: an element named like furniture that holds this share of a page's text is its frame
FRAME = 0.8
#: a container with an id like furniture is furniture with this share of linked characters, or without
#: a heading and below so many characters a tag
LINKED = 1 / 3
SPARSE = 100


def _names(value: str) -> set[str]:
    out: set[str] = set()
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[-1] in _STATES:
            continue
        for part in parts:
            if part in _ABOUT:
                break
            out.add(part)
    return out


class Page:
    """The DOM of a page in preorder arrays, with its texts and block boundaries as events."""

    def __init__(self, source: str):
        self.tag = ["#root"]
        self.parent = [0]
        self.attrs = [""]
        #: (node, text), or (node, None) where a block begins or ends
        self.events: list[tuple[int, str | None]] = []
        self._parse(source)

    def _open(self, name: str, attrs: str, stack: list[int]) -> int:
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.attrs.append(attrs)
        if name in BLOCK:
            self.events.append((node, None))
        return node

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if self.tag[node] in BLOCK:
                self.events.append((node, None))

    def _find(self, stack: list[int], names: set[str], until: set[str]) -> int:
        """Depth of the innermost open element with one of the names, 0 if a scope ends before."""
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[depth]]
            if name in names:
                return depth
            if name in until:
                return 0
        return 0

    def _parse(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        opened: dict[str, int] = {}
        while at < size:
            match = _TOKEN.search(source, at)
            if match is None:
                self._text(stack[-1], source[at:])
                break
            if match.start() > at:
                self._text(stack[-1], source[at : match.start()])
            at = match.end()
            name = match[2] or match[5]
            if name is None:
                continue
            name, closing, attrs = name.lower(), match[1] or match[4], match[3] or match[6] or ""
            if closing:
                if opened.get(name, 0):
                    depth = self._find(stack, {name}, set() if name in BLOCK else {"td", "th", "table", "article", "main", "body"})
                    if depth:
                        for node in stack[depth:]:
                            opened[self.tag[node]] -= 1
                        self._close(stack, depth)
                continue
            depth = 0
            if name in BLOCK and opened.get("p", 0):
                depth = self._find(stack, {"p"}, SCOPE)
            if name in CLOSED_BY:
                victims = {k for k, v in CLOSED_BY.items() if name in v}
                depth = self._find(stack, victims, {"table", "ul", "ol", "dl", "select"}) or depth
            if depth:
                for node in stack[depth:]:
                    opened[self.tag[node]] -= 1
                self._close(stack, depth)
            node = self._open(name, attrs, stack)
            if name == "br":
                self.events.append((node, " "))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
            elif name not in VOID and not attrs.endswith("/"):
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
            elif name in BLOCK:
                self.events.append((node, None))
            if name in RAW and at < size:
                at = source.find(">", at) + 1 or size

    def _text(self, node: int, raw: str) -> None:
        self.events.append((node, html.unescape(raw) if "&" in raw else raw))


def _values(attrs: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(attrs)}


def _looks(page: Page) -> list[bool]:
    """Whether the text of each node looks like furniture: mostly linked, or sparse and without a heading."""
    n = len(page.tag)
    chars, linked, tags, headed, in_link = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for node, text in page.events:
        if text:
            size = len("".join(text.split()))
            chars[node] += size
            linked[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        chars[up] += chars[i]
        linked[up] += linked[i]
        tags[up] += tags[i] + 1
        headed[up] = headed[up] or headed[i] or page.tag[i] in HEADINGS
    return [linked[i] >= LINKED * chars[i] or (not headed[i] and chars[i] < SPARSE * max(tags[i], 1)) for i in range(n)]


def _cut(page: Page) -> list[bool]:
    """Whether each node is left out, itself or with an ancestor."""
    n = len(page.tag)
    flagged, comment, names_of, by_name = [False] * n, [False] * n, [set()] * n, [False] * n
    by_id: list[int] = []
    for i in range(1, n):
        attrs = page.attrs[i]
        noisy = page.tag[i] in FURNITURE
        if attrs and attrs != "/":
            values = _values(attrs)
            classes = _names(values.get("class", ""))
            names = set() if page.tag[i] in PROSE else classes | _names(values.get("id", ""))
            names_of[i] = names
            comment[i] = bool(names & COMMENTS)
            by_name[i] = bool(names & NAMES) and not noisy and not comment[i]
            if (comment[i] or by_name[i]) and not noisy and not classes & (NAMES | COMMENTS):
                by_id.append(i)
            noisy = noisy or comment[i] or by_name[i] or values.get("role", "").lower() in ROLES
            if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or ("style" in values and _HIDDEN.search(values["style"])):
                noisy, by_name[i] = True, False
                if by_id and by_id[-1] == i:
                    by_id.pop()
            elif by_id and by_id[-1] == i and values.get("role", "").lower() in ROLES:
                by_id.pop()
        flagged[i] = noisy
    if by_id:  # headings lend their words to ids: in an article these count only where the text agrees
        looks, within = _looks(page), [False] * n
        some = any(t in CONTAINERS for t in page.tag)
        for i in range(1, n):
            within[i] = within[page.parent[i]] or page.tag[i] in CONTAINERS
        for i in by_id:
            if not looks[i] and (within[page.parent[i]] or not some):
                flagged[i] = comment[i] = by_name[i] = False
                names_of[i] = set()
    # pages name their outer elements after what these hold; what holds an article is not furniture
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if page.tag[i] in CONTAINERS and not comment[i]:
            holds[i] = True
            flagged[i] = False
        if holds[i]:
            holds[page.parent[i]] = True
        if page.tag[i] in ("html", "body"):
            flagged[i] = False
    if any(by_name) and not holds[0]:
        size = [0] * n
        for node, text in page.events:
            size[node] += len(text or "")
        for i in range(n - 1, 0, -1):
            if flagged[i] and not by_name[i]:
                size[i] = 0
            size[page.parent[i]] += size[i]
        for i in range(1, n):
            if by_name[i] and size[i] >= FRAME * size[0]:
                flagged[i] = False
    inside = [False] * n
    out = [False] * n
    for i in range(1, n):
        up = page.parent[i]
        inside[i] = inside[up] or (page.tag[i] in CONTAINERS and not out[up])
        noisy = flagged[i] and not (holds[i] and not comment[i])
        if noisy and inside[up] and page.tag[i] not in HEADINGS and (page.tag[i] == "header" or names_of[i] & {"header"}) and not comment[i]:
            noisy = False  # an article's own header: only its headings belong to the text
            page.tag[i] = "#header"
        under_header = page.tag[up] == "#header" or page.tag[up] == "#header-part"
        if under_header and page.tag[i] not in HEADINGS:
            page.tag[i] = "#header-part"
        out[i] = out[up] or noisy
    return out


def _densities(page: Page, out: list[bool]) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every node that stays."""
    n = len(page.tag)
    chars, linked, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for node, text in page.events:
        if text and not out[node] and page.tag[node] not in ("#header", "#header-part"):
            size = len("".join(text.split()))
            chars[node] += size
            if in_link[node]:
                linked[node] += size
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if out[i]:
            continue
        chars[up] += chars[i]
        linked[up] += linked[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + in_link[i]
    share = linked[0] / chars[0] if chars[0] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if out[i] or not chars[i]:
            continue
        c, lc, t, lt = chars[i], max(linked[i], 1), max(tags[i], 1), max(link_tags[i], 1)
        plain = max(c - linked[i], 1)
        base = math.log(c / plain * linked[i] + share * c + math.e)
        density[i] = c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(base) if base > math.e else c / t * max(math.log(c / lc * t / lt), 0.0)
        if i:
            sums[page.parent[i]] += density[i]
    return density, sums


def _chosen(page: Page, out: list[bool]) -> list[bool]:
    """Which nodes belong to the article."""
    n = len(page.tag)
    density, sums = _densities(page, out)
    inner = [i for i in range(n) if not out[i] and density[i] > 0]
    keep = [False] * n
    if not inner:
        return [not o for o in out]
    # a node without children carries its own density
    weight = [max(sums[i], density[i]) if sums[i] == 0 else sums[i] for i in range(n)]
    top = max(inner, key=lambda i: (weight[i], -i))
    threshold, i, path = density[top], top, []
    while i and page.tag[i] not in ("body", "html"):
        path.append(i)
        if density[i] > 0:
            threshold = min(threshold, density[i])
        i = page.parent[i]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not out[i] and (weight[best[i]], -best[i]) > (weight[best[up]], -best[up]) and best[up] != 0:
            best[up] = best[i]
    # the outermost article on the path is whole, or the outermost main where there is no article
    holding = [i for i in path if page.tag[i] == "article"] or [i for i in path if page.tag[i] in CONTAINERS]
    for i in inner:
        if density[i] >= threshold and page.tag[i] not in ("#root", "html", "body") and i not in path:
            keep[i if page.tag[i] in CONTAINERS or page.parent[i] in path else best[i]] = True
    if holding:
        keep[holding[-1]] = True
    else:
        for i in path:
            keep[best[i]] = True
    keep[top] = True
    # beside the article a main element still holds its headings and its own text
    around = set(path[path.index(holding[-1]) + 1 :]) if holding else set()
    while around and page.tag[max(around, key=path.index)] not in CONTAINERS:
        around.remove(max(around, key=path.index))
    for i in range(1, n):
        if page.parent[i] in around and page.tag[i] in PROSE:
            keep[i] = True
    for i in range(1, n):
        keep[i] = keep[i] or keep[page.parent[i]]
    return [(k or i in around) and not o for i, (k, o) in enumerate(zip(keep, out, strict=True))]


def main_text(source: str) -> str:
    """The article of a page: its blocks in page order, one on a line."""
    page = Page(source)
    out = _cut(page)
    keep = _chosen(page, out)
    blocks: list[str] = []
    now: list[str] = []
    for node, text in page.events:
        if text is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif keep[node] and page.tag[node] not in ("#header", "#header-part"):
            now.append(text)
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, html_col: str, carry: list[str]) -> DataFrame:
    """``carry`` with ``text``, the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sources in textkit.chunks(batches, "_html"):
            texts = [main_text(textkit.decoded(s)) for s in sources]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string())], names=[*piece.schema.names[:-1], "text"])

    rows = pages.select(*carry, F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, rows.drop("_html").schema.add("text", "string"))

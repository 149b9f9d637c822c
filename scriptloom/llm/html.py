"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is its
length, or 0 where more than half of it is link text. Weights are summed over
sliding windows of ``WINDOW`` lines; one container border between two lines counts
as an empty line, more as ``WINDOW``, so that the sums fall between separate parts
of a page. The text surges where a sum rises from nothing and dives where it falls
to nothing; what lies between is a region. The page's own distribution sets the threshold: a region counts where it
holds a window of at least 1 / ``SHARE`` of the page's largest one.

Tags and names only take away what cannot be text: ``nav footer aside dialog menu
button``, a ``header`` outside an article, scripts and the like; and containers one
of whose class, id or role tokens says in all of its parts that it is boilerplate
(``cookie-notice``, not ``share-price-table``). Forms and containers with a weak
name (``header``, ``search``, ``widget`` ..) stay where they hold a line at least half as
long as the page's longest; all named ones stay where they hold the ``h1``.

Where an article (or else main) element holds a counting window, all of its lines
are the text. Elsewhere it is the counting regions, with what joins them: any line
between two of them, a heading's region before them, a short region of paragraphs
whose container is like theirs, and linked paragraphs beside their lines.

Inside a line character references are decoded and white space (``br`` and cell
borders too) becomes one space; lines are joined by one line feed. Nothing is
capped. Time is linear in the page's length.

Defined results: null or empty html, and pages without a region, give the empty
text; cut-off pages are read as far as they go (an unfinished tag is dropped);
repeated rows are read one by one; null ids and urls are carried; extra columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts_of

WINDOW, SHARE = 3, 8
_TAG = re.compile(r"<(?:!--(?s:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+|[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
RAW = frozenset("script style textarea title noscript iframe template svg object select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINER = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr li dt dd tr option caption figcaption legend summary".split())
CELL = frozenset(("td", "th"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_NAMED = frozenset("html body article main h1".split())
STRIPPED = frozenset("nav footer aside dialog menu button".split())
#: Words that name boilerplate. A token of a class, id or role counts where all of its words are here or in PLACES.
STRONG = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disclaimer disqus gdpr modal nav navbar navigation "
    "newsletter outbrain pager pagination paywall popup promo promoted promotion replies responses share sharing sidebar signup social sponsor sponsored subscribe subscription taboola".split()
)
WEAK = frozenset("footer form header masthead menu notice notices recommended related reply search teaser teasers toolbar trending widget".split())
PLACES = frozenset(
    "area articles bar block body bottom box button buttons container content form global icons inline inner item items left link links list main page panel post posts primary rail reader readers right secondary section site slot "
    "sticky stories text thread threads top unit user visitor wrap wrapper".split()
)
_PART = re.compile(r"[^a-z0-9]+")
_KEEP, _STRIP, _STRONG, _WEAK, _OWN_HEADER = range(5)


def _names(attributes: str) -> list[str]:
    return [t for m in _NAMES.finditer(attributes) for t in (m[2] or m[3] or m[4] or "").lower().split()]


def named(attributes: str) -> int:
    """Whether a name among the attributes is one of boilerplate, and how strong."""
    out = _KEEP
    for token in _names(attributes):
        # a size or a number (ad-300x250, comment-17) says nothing
        parts = [p for p in _PART.split(token) if p and not p.replace("x", "").isdigit()]
        if parts and all(p in STRONG or p in WEAK or p in PLACES for p in parts):
            if any(p in STRONG for p in parts):
                return _STRONG
            if any(p in WEAK for p in parts):
                out = _WEAK
    return out


class _Node:
    """A container of the page, or another element with a name of boilerplate."""

    __slots__ = ("parent", "depth", "tag", "look", "kind", "level", "title", "longest", "gone", "own_header")

    def __init__(self, parent: _Node | None, tag: str, kind: int, look: str = ""):
        self.parent, self.tag, self.kind, self.look = parent, tag, kind, look
        self.depth = parent.depth + 1 if parent else 0
        self.level = max(parent.level if parent else 0, {"article": 2, "main": 1}.get(tag, 0))
        self.title, self.longest, self.gone, self.own_header = False, 0, False, False


class _Line:
    __slots__ = ("text", "weight", "node", "block")

    def __init__(self, text: str, weight: int, node: _Node, block: str):
        self.text, self.weight, self.node, self.block = text, weight, node, block


class _Page:
    """Collects lines and the containers they lie in, in page order."""

    def __init__(self) -> None:
        self.nodes = [_Node(None, "", _KEEP)]
        self.stack = [self.nodes[0]]
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.linked = self.link = 0
        self.block = ""

    def text(self, raw: str) -> None:
        if self.stack[-1].tag == "button":
            return
        value = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(value)
        if self.link:
            self.linked += len(value.strip())

    def flush(self) -> None:
        if not self.parts:
            return
        line = " ".join("".join(self.parts).split())
        linked, self.parts, self.linked = self.linked, [], 0
        if line:
            self.lines.append(_Line(line, 0 if 2 * linked > len(line) else len(line), self.stack[-1], self.block))

    def opened(self, tag: str, attributes: str) -> None:
        kind = named(attributes) if attributes and (tag in BLOCK or tag in CELL) and tag not in NEVER_NAMED else _KEEP
        if tag in BLOCK or kind:
            self.flush()
            self.block = tag
            while len(self.stack) > 1 and (self.stack[-1].tag == "p" or (tag not in CONTAINER and self.stack[-1].tag == tag)):
                self.stack.pop()
        elif tag == "br" or tag in CELL:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in STRIPPED:
            kind = _STRIP
        elif tag == "header":
            kind = _OWN_HEADER if self.stack[-1].level else _STRIP
        elif tag == "form":
            kind = max(kind, _WEAK)
        if tag in CONTAINER or kind:
            self.nodes.append(_Node(self.stack[-1], tag, kind, f"{tag} {' '.join(_names(attributes))}" if attributes else tag))
            self.stack.append(self.nodes[-1])
        if tag == "a":
            self.link += 1
        if tag == "h1":
            self.stack[-1].title = True

    def closed(self, tag: str) -> None:
        if tag in BLOCK or (tag in CELL and self.stack[-1].tag == tag):
            self.flush()
            self.block = ""
        if tag == "a":
            self.link = max(0, self.link - 1)
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break


def read(page: str) -> _Page:
    """All lines of a page, without scripts and the like."""
    out, at, n = _Page(), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.closed(tag)
        elif tag in RAW:
            # only a foreign element can close itself; HTML takes a slash at the end of a tag, or of a bare value, for nothing
            if tag != "svg" or not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
        else:
            out.opened(tag, m[3])
    out.flush()
    return out


def text_lines(page: _Page) -> list[_Line]:
    """The lines outside boilerplate."""
    for line in page.lines:
        line.node.longest = max(line.node.longest, len(line.text))
    for node in reversed(page.nodes[1:]):
        node.parent.longest = max(node.parent.longest, node.longest)
        node.parent.title = node.parent.title or node.title
    # what is stripped does not tell how long this page's text is
    longest = 0
    for node in page.nodes[1:]:
        node.gone = node.parent.gone or node.kind == _STRIP or (node.kind == _STRONG and not node.title)
    for line in page.lines:
        if not line.node.gone:
            longest = max(longest, len(line.text))
    for node in page.nodes[1:]:
        short = node.kind == _WEAK and not node.title and 2 * node.longest < longest
        node.gone = node.gone or node.parent.gone or short
        node.own_header = node.parent.own_header or node.kind == _OWN_HEADER
    return [x for x in page.lines if not x.node.gone and (not x.node.own_header or x.block == "p" or x.block in HEADING)]


def borders(a: _Node, b: _Node) -> int:
    """Container borders between two places: to the nearest common container and down again."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def regions(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open line ranges between surge and dive points of the windowed text lengths."""
    sums = windowed(lengths, window)
    out, begin = [], None
    for k, s in enumerate(sums):
        if s and begin is None:
            begin = k  # surge: the first line whose window is not empty
        elif not s and begin is not None:
            out.append((begin, k - window + 1))  # dive: the whole window is empty
            begin = None
    if begin is not None:
        out.append((begin, len(lengths)))
    return out


def windowed(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Sum of the window that ends at each line."""
    out, total = [], 0
    for k, x in enumerate(lengths):
        total += x - (lengths[k - window] if k >= window else 0)
        out.append(total)
    return out


def spaced(lines: list[_Line]) -> list[_Line | None]:
    """The lines with empty ones (None) where borders are crossed."""
    out: list[_Line | None] = []
    for k, line in enumerate(lines):
        n = borders(lines[k - 1].node, line.node) if k else 0
        out += [None] * (n if n < 2 else WINDOW)
        out.append(line)
    return out


def largest(lines: list[_Line]) -> int:
    return max(windowed([x.weight if x else 0 for x in spaced(lines)]), default=0)


def _joined(rows: list[_Line | None], found: list[tuple[int, int]], counts: list[bool]) -> list[_Line]:
    """Lines of the counting regions and of what joins them."""
    first, last = counts.index(True), len(counts) - 1 - counts[::-1].index(True)
    begin, end = found[first][0], found[last][1]

    def lines(k: int) -> list[_Line]:
        return [x for x in rows[slice(*found[k])] if x]

    def alike(k: int, edge: _Line) -> bool:
        some = lines(k)
        same = all(x.node.look == edge.node.look and borders(x.node, edge.node) <= 2 for x in some)
        return same and all(x.block == "p" or x.block in HEADING for x in some)

    while first > 0 and (alike(first - 1, rows[begin]) or all(x.block in HEADING for x in lines(first - 1))):
        first, begin = first - 1, found[first - 1][0]
    while last + 1 < len(found) and alike(last + 1, rows[end - 1]):
        last, end = last + 1, found[last + 1][1]
    # linked paragraphs beside the first and the last line
    beside = lambda x, edge: x is not None and x.node is edge.node and x.block == "p"
    while begin > 0 and beside(rows[begin - 1], rows[begin]):
        begin -= 1
    while end < len(rows) and beside(rows[end], rows[end - 1]):
        end += 1
    return [x for x in rows[begin:end] if x]


def main_text(page: str) -> str:
    lines = text_lines(read(page))
    if not any(x.weight for x in lines):
        for x in lines:  # all paragraphs are links: they are the text
            x.weight = len(x.text) if x.block == "p" else 0
    rows = spaced(lines)
    weights = [x.weight if x else 0 for x in rows]
    sums = windowed(weights)
    least = max(1, -(-max(sums, default=0) // SHARE))
    for level in (2, 1):
        inside = [x for x in lines if x.node.level >= level]
        if inside and largest(inside) >= least:
            return "\n".join(x.text for x in inside)
    found = regions(weights)
    counts = [max(sums[a:b], default=0) >= least for a, b in found]
    return "\n".join(x.text for x in _joined(rows, found, counts)) if any(counts) else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(x) for x in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")

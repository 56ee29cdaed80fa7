"""Main text of web pages by line-block distribution.

A page is read into lines, one a block element, with its markup stripped; each line gets a weight.
A line's weight is its length outside links.  Markup only changes weights: lines of elements that by tag, role, class or id are navigation,
banners, adverts, forms, notices, sidebars, footers or reader comments weigh ``AGAINST``, unless such an
element wraps most of the page's article or main elements or, for forms, roles and names, most of the page's
text; lines of article and main elements with text outside links weigh at least ``SURGE`` of the mean line.

The weights are summed over a sliding window of ``WINDOW`` lines, lines against the text left aside.  Where the sum
surges (it passes the ``SURGE`` share of the page's mean) a run opens at the first line that carries it; where it dives to nothing,
``WINDOW`` lines of links or less, it closes behind the last line that does; all lines in between are kept,
but those of the weight ``AGAINST``, at which a run is cut.  Where the page marks no article, short lines at the rims that
aren't mostly links belong to a run too.  A run counts with ``RIVAL`` of the longest run's text, or with a line of the ``SURGE`` share in
an article.  What the surge and dive points leave is the text; nothing is picked by markup alone.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by a line end in page order.  A null page is empty and gives an empty text; a page
that ends in the middle of a tag, comment or element is read up to there.  Long and deep pages take time in
proportion to their length.  Repeated rows give a row each, an empty table gives no rows.  Extra columns are kept; one named like the output
is kept under that name with ``_`` behind it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
SURGE = 0.5
RIVAL = 0.25
AGAINST = -1

# Fixed values of HTML: elements that start a block, that hold no children, that hold no text to read.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|select|title"
DROPPED = frozenset("nav footer aside form header menu dialog button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
# Parts of class and id names, between - and _, that mark an element wherever they stand, but behind "with", "has", "no" and the like.
PARTS = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments commentlist disqus discussion respond reply replies cookie cookies consent gdpr sidebar footer newsletter signup notification notifications recommended trending bio breadcrumb breadcrumbs".split())
WITHOUT = frozenset("with has have no without is hide show not".split())
# Text that is written beside an article and may be longer than it.
BESIDE = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments commentlist disqus discussion respond reply replies cookie cookies consent gdpr related recommended trending".split())
# Names that only mark an element as a whole, and the usual compounds of them.
NAMES = re.compile(
    r"(?:banner|sponsor|promo|side|menu|nav(?:bar|igation)?|header|masthead|notice|popup|modal|subscribe|share|social|related|widget|toolbar|pagination|site-info"
    r"|(?:site|page|global|top|main|primary|secondary|left|right|bottom|mobile)[_-](?:header|nav(?:bar|igation)?|menu|banner|toolbar)"
    r"|(?:promo|sponsor|social|share|sharing|popup|modal|subscribe|nav|menu|related|widget)[_-](?:banner|bar|box|notice|container|wrapper|lists?|section|area|form|links?|buttons?|slot|unit|items?|posts|articles|stories|block))",
    re.I,
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<icon>svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Line:
    text: str
    links: int  # characters inside links
    home: int  # number of the article or main element around, 0 if none
    against: bool  # in an element that is no main text by its markup

    @property
    def size(self) -> int:
        return len(self.text) - self.links


@dataclass
class Aside:
    """An element that its markup marks as no main text, with its characters outside links."""

    mark: str  # "firm" is never kept for its length, "beside" only where nothing stands around it
    outside: bool  # no article or main element around
    size: int = 0
    held: int = 0  # those in articles or main elements that lie inside


def _named(token: str) -> str:
    """What a class or id says: "beside", "soft" or ""."""
    parts = re.split("[-_]+", token.lower())
    for k, part in enumerate(parts):
        if part in PARTS and not (k and parts[k - 1] in WITHOUT):
            return "beside" if part in BESIDE else "soft"
    if NAMES.fullmatch(token):
        return "beside" if parts[0] in BESIDE else "soft"
    return ""


def _unwanted(tag: str, attrs: str, inside: bool) -> str:
    """Whether an element is no main text by its markup: "firm" by its tag, "beside" and "soft" by name, tag form or role, or ""."""
    if tag in DROPPED:
        return "soft" if tag == "form" else "" if tag == "header" and inside else "firm"
    if not attrs or tag in ("body", "html", "article", "main"):
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    names = {_named(t) for k in ("class", "id") for t in found.get(k, "").split()}
    if "beside" in names:
        return "beside"
    hidden = found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in attrs.lower().split()
    return "soft" if "soft" in names or hidden else ""


def _overruled(asides: list[Aside], size: int, held: int) -> frozenset[int]:
    """Numbers of the elements that hold the page's main text all the same.

    ``size`` and ``held`` are the characters outside links of the page and of its articles and main
    elements.  An element stays when it holds most of ``held``; a soft one also when it holds most of
    ``size`` and no article stands beside it.
    """
    wraps = lambda x: 2 * x.held > held
    long = lambda x: x.mark != "firm" and 2 * x.size > size and not (x.outside and held > x.held) and not (x.mark == "beside" and size > x.size)
    return frozenset(k for k, x in enumerate(asides) if wraps(x) or long(x))


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order; those of elements that are no main text by markup and length are ``against``."""
    lines, asides, size, held = _read(page)
    kept = _overruled(asides, size, held)
    return _read(page, kept)[0] if kept else lines


def _read(page: str, kept: frozenset[int] = frozenset()) -> tuple[list[Line], list[Aside], int, int]:
    """Lines, marked elements (those of the numbers ``kept`` mark no line), and characters outside links: all, in articles."""
    lines: list[Line] = []
    asides: list[Aside] = []
    total, inner = 0, 0
    parts: list[str] = []
    beside: list[str] = []  # what the block says in marked elements
    links = 0
    stack: list[tuple[str, bool, int, int, int, int]] = []  # tag, whether it marks lines, article around it, number of its aside or -1, total and inner before it
    depth: dict[str, int] = {}  # open elements by tag
    out, link, home, homes, at = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal links
        for own, against in ((parts, False), (beside, True)):
            text = " ".join(html.unescape("".join(own)).split())
            if text:
                lines.append(Line(text, 0 if against else links, home, against))
                break
        parts.clear()
        beside.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal total, inner, links
        if not text:
            return
        n = 0 if link else len(text.strip())
        total += n
        inner += n if home else 0
        if out:
            beside.append(text)
            return
        parts.append(text)
        if link:
            links += len(text)

    def pop(tag: str) -> None:
        nonlocal out, link, home
        while stack:
            name, marks, around, aside, before, within = stack.pop()
            depth[name] -= 1
            out -= marks
            link -= name == "a"
            if aside >= 0:
                asides[aside].size = total - before
                asides[aside].held = inner - within if asides[aside].outside else 0
            home = around
            if name == tag:
                return

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] or m["icon"]:
                say(" ")
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            flush()
        if m["close"]:
            if depth.get(tag):
                pop(tag)
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag == "p" and any(x[0] == "p" for x in stack[-3:]) or tag == "li" and stack and stack[-1][0] == "li":
            pop(tag)  # these end where the next one begins
        marked = _unwanted(tag, m["attrs"], home > 0)
        marks = bool(marked) and len(asides) not in kept
        stack.append((tag, marks, home, len(asides) if marked else -1, total, inner))
        depth[tag] = depth.get(tag, 0) + 1
        if marked:
            asides.append(Aside(marked, not home))
        out += marks
        link += tag == "a"
        if tag in ("article", "main") and not home:
            homes += 1
            home = homes
    rest = page[at:]
    cut = re.search(r"<[/!?a-zA-Z][^<]*\Z", rest)  # a tag that the page's end cuts off
    say(rest[: cut.start()] if cut else rest)
    flush()
    pop("")
    return lines, asides, total, inner


def weights(lines: list[Line], window: int = WINDOW) -> tuple[list[int], float, float]:
    """Each line's weight, the window sum at which text surges and the weight from which on a line carries it.

    A weight is the length outside links, in articles at least a surge by itself, ``AGAINST`` where markup speaks against the line.
    """
    own = [x.size for x in lines if not x.against]
    sums = [sum(own[i : i + window]) for i in range(len(own))]
    level, least = (SURGE * sum(x) / max(len(x), 1) for x in (sums, own))
    return [AGAINST if x.against else max(x.size, int(level) + 1) if x.home and x.size else x.size for x in lines], level, least


def runs(weight: list[int], level: float, least: float, loose: list[bool], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Stretches between a surge and its dive, each as the pieces (first, end) between lines of the weight ``AGAINST``.

    ``loose`` lines at the rims of a stretch belong to it though they don't carry it.
    """
    lines = [i for i, w in enumerate(weight) if w != AGAINST]
    size = [weight[i] for i in lines]
    sums = [sum(size[i : i + window]) for i in range(len(size))]
    found, start = [], None
    for i, x in enumerate([*sums, 0]):
        if start is None and x > level:
            start = i
        elif start is not None and x == 0:
            own = [k for k in range(start, i) if size[k] > least]
            if own:
                found.append([own[0], own[-1] + 1])
            start = None
    for k, run in enumerate(found):
        while run[0] > (found[k - 1][1] if k else 0) and loose[lines[run[0] - 1]]:
            run[0] -= 1
        while run[1] < (found[k + 1][0] if k + 1 < len(found) else len(lines)) and loose[lines[run[1]]]:
            run[1] += 1
    out = []
    for a, b in found:
        pieces = [[lines[a], lines[a] + 1]]
        for i in lines[a + 1 : b]:
            if i == pieces[-1][1]:
                pieces[-1][1] += 1
            else:
                pieces.append([i, i + 1])
        out.append([(x, y) for x, y in pieces])
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    weight, level, least = weights(lines)
    if not any(w > 0 for w in weight):
        return "\n".join(x.text for x in lines if x.home and not x.against)
    articles = any(x.home and w > 0 for x, w in zip(lines, weight, strict=True))
    found = runs(weight, level, least, [not articles and 2 * x.links <= len(x.text) for x in lines])
    size = [0 if x.against else x.size for x in lines]
    held = [sum(size[i] for a, b in run for i in range(a, b)) for run in found]
    inside = [any(lines[i].home and size[i] > least for a, b in run for i in range(a, b)) for run in found]
    kept = [run for run, n, own in zip(found, held, inside, strict=True) if own or n >= RIVAL * max(held)]
    return "\n".join(lines[i].text for run in kept for a, b in run for i in range(a, b))


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``column`` in its place, as ``into``."""
    own = [c for c in pages.columns if c != column]
    names = list(own)
    while into in names:
        names[names.index(into)] += "_" * (1 + sum(c.startswith(into + "_") for c in names))
    inner = pages.select(*own, F.col(column)).toDF(*(f"c{i}" for i in range(len(own))), "page")
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("text", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                text = pa.array([main_text(x) for x in batch.column("page").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=schema.names)

    return inner.mapInArrow(read, schema).toDF(*names, into)

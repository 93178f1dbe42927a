"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, and threshold clustering.

The standard library's streaming parser turns a page into blocks, one line each: the text between two block-level tags, with
the number of tags since the last line. Each line's ratio of text to tags is smoothed over the lines around it by a Gaussian; lines
above a threshold, a share of the smoothed ratios' standard deviation, are content-like. Neighbouring content-like lines are
a cluster, those with a fifth of the heaviest one's text or more are kept, and the deepest container that holds at least
four fifths of their text is the content region. It grows to its parent as long as that adds only headings and content-like lines.

Tags only correct this: blocks inside menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles
and reader comments, known by their tags, roles, classes and ids, are boilerplate, neither counted in clusters nor given out, and
a region inside an article or main element is all of that element. All other blocks of the region are the text.

Character references are decoded, white space within a block becomes one space, blocks are trimmed, empty ones left out, and
joined by line feeds. Null, empty, or nothing but boilerplate: an empty text. A page cut off inside a tag loses just that tag.
Repeated rows and null keys pass as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

SIGMA, SHARE, KEPT, HELD = 1.0, 0.5, 0.2, 0.8
# Tags and words of the HTML vocabulary.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav aside footer form button select textarea iframe object svg canvas dialog menu".split())
CONTAINERS = frozenset("article main section body html div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|topbar"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|related|recommended|widget|toolbar|pagination|pager|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Elements that stand for the page's own content whatever they are called.
_TRUSTED = frozenset(("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", "p"))
_CLOSES_P = BLOCKS - {"br", "html", "head", "body", "title", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "summary", "figcaption"}
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<(?:!|\?|/?[A-Za-z])[^<>]*\Z")


class Line(NamedTuple):
    text: str
    tags: int
    noise: bool
    node: int


class _Lines(HTMLParser):
    """Blocks of a page, and the tree of elements that matter: the tag of each node and its parent, which comes before it."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open elements that matter: tag, boilerplate from here on, node; plain inline elements don't
        self.open: list[tuple[str, bool, int]] = []
        self.count: Counter[str] = Counter()
        self.kinds, self.parents, self.lines, self.text, self.tags = ["page"], [0], [], [], 0

    def _state(self) -> tuple[bool, int]:
        return self.open[-1][1:] if self.open else (False, 0)

    def _line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, *self._state()))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in _CLOSES_P:
            self._close("p", {"article", "section", "div", "main", "aside", "nav", "footer", "header", "form", "td", "th", "li", "body"})
        elif tag in ("td", "th", "tr", "option"):
            self._close(tag, {"table", "select"})
        if tag == "li":
            self._close("li", {"ul", "ol", "menu"})
        above, parent = self._state()
        named = dict(attrs)
        inside = self.count["article"] + self.count["main"] > 0
        noise = above or tag in DROPPED or (tag == "header" and not inside) or (named.get("role") or "").lower() in ROLES or "hidden" in named or (named.get("aria-hidden") or "") == "true"
        noise = noise or (tag not in _TRUSTED and any(NOISE.search(v) for k in ("class", "id") if (v := named.get(k))))
        if tag in BLOCKS or tag in DROPPED or noise != above:
            self.open.append((tag, noise, len(self.kinds)))
            self.kinds.append(tag)
            self.parents.append(parent)
            self.count[tag] += 1

    def _close(self, tag, within=frozenset()) -> None:
        """Closes the innermost such element, unless one of ``within`` lies between."""
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.count.subtract(t for t, _, _ in self.open[k:])
                del self.open[k:]
                return
            if self.open[k][0] in within:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag not in VOID:
            self._close(tag, {"article", "main", "body"} if tag not in ("article", "main", "body", "html") else frozenset())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not (self.open and self.open[-1][1] and self.open[-1][0] not in BLOCKS):  # boilerplate within a block
            self.text.append(data)


def lines(html: str) -> tuple[list[Line], list[str], list[int]]:
    """The page's lines, and of each node its tag and its parent."""
    parser = _Lines()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser._line()
    return parser.lines, parser.kinds, parser.parents


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a Gaussian out to three deviations; beyond the ends the outermost values go on."""
    r = int(np.ceil(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, r, mode="edge"), weight / weight.sum(), mode="valid")


def content_like(found: list[Line], sigma: float = SIGMA, share: float = SHARE) -> np.ndarray:
    """Which lines have a smoothed ratio of text to tags of at least that share of the ratios' deviation."""
    smooth = smoothed(np.array([len(x.text) / max(1, x.tags) for x in found]), sigma)
    return smooth >= share * smooth.std()


def region(found: list[Line], kinds: list[str], parents: list[int], like: np.ndarray, kept: float = KEPT, held: float = HELD) -> int:
    """The node of the content region: clusters of content-like lines, and what holds most of them."""
    size = np.array([0 if x.noise else len(x.text) for x in found])
    weight = size * like
    cluster = np.cumsum(np.append(True, weight[1:].astype(bool) != weight[:-1].astype(bool))) - 1
    total = np.bincount(cluster, weight)
    weight = np.where(total[cluster] >= kept * total.max(), weight, 0)
    own = np.bincount([x.node for x in found], weight, len(kinds))
    # what a node has beyond the lines that a growing region may take
    other = np.bincount([x.node for x in found], (size > 0) & ~like & [kinds[x.node] not in HEADINGS for x in found], len(kinds))
    for n in range(len(kinds) - 1, 0, -1):
        own[parents[n]] += own[n]
        other[parents[n]] += other[n]
    at = int(np.flatnonzero(own >= held * own[0])[-1])
    while at and kinds[at] not in CONTAINERS:
        at = parents[at]
    while at and other[parents[at]] == other[at]:
        at = parents[at]
    above = at
    while above:
        if kinds[above] in ("article", "main"):
            at = above
        above = parents[above]
    return at


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    found, kinds, parents = lines(html or "")
    calm = np.array([not x.noise for x in found])
    if not calm.any():
        return ""
    like = content_like(found, sigma, share)
    if not (like & calm).any():
        like = calm
    chosen = region(found, kinds, parents, like)
    inside = [False] * len(kinds)
    for n in range(len(kinds)):
        inside[n] = n == chosen or inside[parents[n]]
    return "\n".join(x.text for x in found if not x.noise and inside[x.node])


def _kernel(batches):
    for batch in batches:
        texts = [main_text(None if h is None else h.decode("utf-8", "replace")) for h in base.byte_rows(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return base.mapped(base.columns_only(pages, {"page_id": "long", "url": "string", "html": "string"}), _kernel, "page_id long, url string, text string, n_chars long")

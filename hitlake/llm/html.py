"""Main-text extraction from HTML by text-to-tag ratio.

The standard library's parser streams events; block elements cut the page into lines, and each line has its text,
its number of tags and its share of link text. A line's ratio is its text length by its tags. The ratios, smoothed by
a Gaussian over neighbouring lines, are cut in two clusters by a threshold (a two-means split of their logarithms);
the upper one marks content and selects regions. The content region is all article, main and section elements, and,
unless these hold nearly all text outside links, the innermost container of every marked line that does. All its lines
count, short ones too. Outside it a line stays if it is marked, by its neighbours' ratios and its own, prose (a paragraph,
heading, list item ...) and not mostly links.

Lines never count under elements that hold no article's text by their tag, role or hiding attribute (menus, headers
outside the article, footers, sidebars, notices, adverts, forms, scripts, styles), or by a class or id (comments,
cookies, newsletters ...). These are hints: a name counts whole, or when all of its parts are such names or words for
places (comments-list, but not has-sidebar or data-sharing), or by its last part where that is plain (site-nav). A weak
name (share, notice, promotion ...) inside an article hides nothing whose text is marked for the most part. And where
all articles and h1 elements (on pages without them all marked lines), or nearly all text, stand under hints of any
kind, those of them that hold most of the page's text outside links are none: a page within a form or a dialog is read.

Null, empty and textless pages give an empty text; an empty table gives no rows, repeated rows and null ids are kept.
Unclosed tags, stray end tags, a cut-off end and stray entities are tolerated. Work and memory are in proportion to a
page's length, however deep its elements stand in each other. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
MOST = 0.5  # of a page's text outside links, which no element hidden by its name alone holds
NEARLY_ALL = 0.8  # of the allowed text that is no link's, marked or not, for a region
STATED = frozenset("article main section".split())  # the page itself says that these hold content
HOME = frozenset("article main h1".split())
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd figcaption".split())
HIDDEN = frozenset("script style noscript template head title textarea select option button svg iframe object canvas annotation annotation-xml".split())
APART = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body"}
CONTAINERS = frozenset("article main section div td body center table tbody tr html details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Class and id words of what is no main text; those that say little inside an article; words for places.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead header topbar cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup comment comments commentlist respond replies disqus recommended share sharing social widget widgets toolbar pagination pager".split())
WEAK = frozenset("banner promotion header notice respond share sharing social widget widgets toolbar overlay".split())
PLACES = frozenset("area bar block body box col column container content form holder inner left links list outer panel policy right section slot thread top bottom wrap wrapper main 1 2 3".split())
WHOLE = frozenset("side related related-posts related-articles related-links related-content recommended-posts skip-link right-col left-col right-column left-column right-rail left-rail".split())
UNLESS = frozenset("has with no without not is enable enabled hide hidden".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
LITTLE = 0.05  # of a page's text outside links: less than that is no page's content while hints hide most


def _named(names: str, inside: bool) -> str:
    """What a class or id says: "" (nothing), "weak" or "strong"; inside: the element stands in an article."""
    found = ""
    for word in names.lower().split():
        parts = [p for p in re.split("[-_]+", word) if p]
        if not parts or parts[0] in UNLESS:
            continue
        own = [p for p in parts if p in NAMES and not (inside and p == "header")]
        if "-".join(parts) in WHOLE or (own and all(p in NAMES or p in PLACES for p in parts)):
            if set(own) - WEAK or not own:
                return "strong"
            found = "weak"
        elif parts[-1] in NAMES - WEAK or (parts[-1] == "header" and not inside):
            return "strong"
    return found


class _Lines(HTMLParser):
    """Lines of a page: (number of the element it stands in, text, number of tags, length of link text).

    Elements are numbered as they open: 0 is the page; tags, parents and hints are by number.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, element number, hidden, inside an article
        self.stands: defaultdict[str, list[int]] = defaultdict(list)  # places in ``open`` of the open elements of a tag
        self.tag, self.parent, self.hint = [""], [0], [""]
        self.tags = self.linked = 0
        self.text: list[str] = []
        self.lines: list[tuple[int, str, int, int]] = []

    def cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((self.open[-1][1] if self.open else 0, text, self.tags, self.linked))
                self.tags = 0
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.cut()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCK:
            self.cut()
            if tag in CLOSES_P:
                self.shut("p", ("div", "article", "section", "td", "li", "blockquote", "body", "main", "aside"))
            if tag == "li":
                self.shut("li", ("ul", "ol", "menu"))
        _, parent, hidden, inside = self.open[-1] if self.open else ("", 0, False, False)
        names = dict(attrs)
        apart = tag in APART or (tag == "header" and not inside) or (names.get("role") or "").lower() in ROLES or "hidden" in names or NOT_SHOWN.search(names.get("style") or "")
        self.tag.append(tag)
        self.parent.append(parent)
        self.hint.append("strong" if apart else "" if tag in ("html", "body", "article", "main") else _named(f"{names.get('class') or ''} {names.get('id') or ''}", inside))
        self.stands[tag].append(len(self.open))
        self.open.append((tag, len(self.tag) - 1, hidden or tag in HIDDEN, inside or tag in ("article", "main")))

    def shut(self, tag: str, within: tuple[str, ...]) -> None:
        """Close the nearest open ``tag`` unless one of ``within`` stands between."""
        if not self.stands[tag]:
            return
        k = self.stands[tag][-1]
        if any(self.stands[t][-1] > k for t in within if self.stands[t]):
            return
        for x in self.open[k:]:
            self.stands[x[0]].pop()
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        if tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self.shut(tag, ("td", "table", "article", "body") if tag not in BLOCK else ())

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self.text.append(data)
        if self.stands["a"]:
            self.linked += len(data)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """x under a Gaussian window; weights that fall outside are left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(x))
    return np.convolve(x, kernel, "full")[cut] / np.convolve(np.ones(len(x)), kernel, "full")[cut]


def threshold(x: np.ndarray) -> float:
    """The split of sorted values with the least squared deviation within both sides; values from it up are the upper cluster."""
    s = np.sort(x)
    if s[0] == s[-1]:
        return float(s[0])
    n, total = np.arange(1, len(s)), np.cumsum(s)[:-1]
    between = n * (total / n - s.mean()) ** 2 + (len(s) - n) * ((s.sum() - total) / (len(s) - n) - s.mean()) ** 2
    return float(s[int(between.argmax()) + 1])


def main_text(html: str | None) -> str:
    """The content region's lines, joined by line ends."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    if re.match("<[a-zA-Z/!?]", page.rawdata):  # a tag that the page's end cuts off
        page.rawdata = ""
    page.close()
    page.cut()
    lines = page.lines
    if not lines:
        return ""
    at, parent = np.array([x[0] for x in lines]), page.parent
    size = np.array([len(x[1]) - min(len(x[1]), x[3]) for x in lines], float)
    plain = size / np.array([max(1, x[2]) for x in lines])
    ratio = np.log1p(smoothed(plain))

    def held(values: np.ndarray) -> np.ndarray:
        """Sums of the lines' values by the elements that they stand in; children have higher numbers."""
        total = np.bincount(at, values, minlength=len(parent)).tolist()
        for e in range(len(parent) - 1, 0, -1):
            total[parent[e]] += total[e]
        return np.array(total)

    def under(own: list[bool]) -> np.ndarray:
        """Of each line whether one of the elements that it stands in has a flag."""
        flags = list(own)
        for e in range(1, len(parent)):
            flags[e] = flags[e] or flags[parent[e]]
        return np.array(flags)[at]

    least = threshold(ratio)
    high = ratio >= least
    stated = under([t in STATED for t in page.tag])
    text, marks = held(size), held(size * high)
    in_article = [False] * len(parent)
    for e in range(1, len(parent)):
        in_article[e] = in_article[parent[e]] or page.tag[parent[e]] in STATED
    hinted = [h == "strong" or (h == "weak" and not (i and 2 * m >= t)) for h, i, m, t in zip(page.hint, in_article, marks.tolist(), text.tolist(), strict=True)]
    allowed = ~under(hinted)
    home = under([t in HOME for t in page.tag]) & (size > 0)
    # hints are not to be trusted if all of the page's own signs of content, or else all marked lines, or nearly all text stand under them
    sure = home if home.any() else high & (size > 0)
    if not sure[allowed].any() or size[allowed].sum() < LITTLE * text[0]:
        allowed = ~under([h and t <= MOST * text[0] for h, t in zip(hinted, text.tolist(), strict=True)])
    marked = high & allowed & (size > 0)
    if not marked.any():
        marked = allowed & (size > 0)
    if not marked.any():
        return ""
    total = (size * allowed).sum()
    keep = stated | (marked & (np.log1p(plain) >= least) & (2 * size > np.array([len(x[1]) for x in lines])) & under([t in PROSE for t in page.tag]))
    if (size * allowed)[stated].sum() < NEARLY_ALL * total:
        # containers of all marked lines stand in each other; elements are numbered as they open, so the last is innermost
        fits = (held(marked.astype(float)) == marked.sum()) & (held(size * allowed) >= NEARLY_ALL * total)
        region = max((e for e in np.flatnonzero(fits).tolist() if page.tag[e] in CONTAINERS), default=0)
        keep |= under([e == region for e in range(len(parent))])
    return "\n".join(x[1] for x, ok in zip(lines, allowed & keep, strict=True) if ok)


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars (code points) of every page's whole html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: b.column(key), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long")

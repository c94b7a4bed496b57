"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing, threshold clusters.

The standard library's parser reports tags and text as they come. Each block of a page is a line; its
ratio is its characters of plain text to its tags, where text in links, and text in a part of the page whose element, role or
class says that it is no content, counts for nothing (but a class or a form says nothing of a part that holds most of the text). The ratios are smoothed, lines over a threshold form clusters,
and the clusters select content regions: the articles that hold them and what they hold elsewhere, or else the innermost container around all.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# HTML elements by what they mean.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title select option datalist button textarea input".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
# Words of class and id names that mark what is no content: readers' comments by any word of a name, others as its first or last word.
READERS = frozenset("comment comments commenter commentlist commenting disqus replies reply respond responses discussion discussions feedback guestbook talkback thread threads".split())
FIRST = frozenset("ad ads adv advert adverts advertisement advertising adbox adsense breadcrumb breadcrumbs cookie cookies consent gdpr modal navbar newsletter overlay pagination popup promo promotion recommended related sidebar signup skip social sponsor sponsored subscribe".split())
LAST = FIRST | frozenset("banner disclaimer footer header masthead menu nav navigation notice pager rail share sharing toolbar topbar widget hidden".split())
#: Words before which a name says that something isn't there, and words of an article's own header.
NOT, OWN_HEADER = frozenset("no has with without not is hide".split()), frozenset("article content entry main page post story title".split())
#: A part of a page that its name or a form marks counts as content all the same if it holds this share of all text (readers' comments: nearly all), and every article.
MARKED_HALF, MARKED_ALL = 0.5, 0.95
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Lines of the Gaussian, and the share of the ratios' standard deviation that a cluster's lines are over.
SIGMA, THRESHOLD = 1.0, 0.5


def marked(names: str) -> str:
    """What class and id names say of a part of a page: "readers" (their comments), "aside", or nothing. Each name is taken as a whole."""
    said = ""
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or parts[0] in NOT:
            continue
        if READERS.intersection(parts):
            return "readers"
        own = parts[-1] in ("header", "banner") and OWN_HEADER.intersection(parts)
        if (parts[0] in FIRST or parts[-1] in LAST) and not own:
            said = "aside"
    return said


class Page(HTMLParser):
    """Lines of a page as the parser's events come: text, characters out of links, tags, and the containers around."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[int, bool, bool, bool, int]]] = []  # element, and what ``at`` was before it
        self.places: dict[str, list[int]] = {}  # of each element's open tags in the stack
        self.bounds: list[int] = []  # places of open containers, and with lists and tables
        self.borders: list[int] = []
        self.parents = [-1]  # of each container; a parent comes before its children
        self.kinds = ["html"]
        self.marks = [(-1, "")]  # parts that a name or a form marks: the one around, and how; the first is the page
        self.mains = [0]  # articles and main elements in each of these
        self.lines: list[tuple[str, int, int, int, bool, int]] = []
        self.text: list[str] = []
        self.plain = self.tags = 0
        self.at = (0, False, False, False, 0)  # container, whether it is boilerplate, whether it has no text, whether an article is around, mark

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.plain, self.tags, self.at[0], self.at[1], self.at[4]))
        self.text, self.plain, self.tags = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.line()
            if tag != "p" and self.places.get("p"):
                self.end("p", within=True)
            elif tag in ("p", "li", "dt", "dd", "tr", "td", "th"):
                self.end(tag, within=True)
        if tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        container, no_content, no_text, in_article, mark = self.at
        # an article's own header holds its headline; the page's header does not
        headline = tag == "header" and in_article
        bad = tag in BOILERPLATE and not headline
        if attrs and not bad:
            names = dict(attrs)
            said = f"{names.get('class') or ''} {names.get('id') or ''}"
            bad = (names.get("role") or "").lower() in ROLES or "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display:\s*none", names.get("style") or "") is not None
            if tag not in ("article", "main", "body", "html") and not headline and said != " " and (kind := marked(said)):
                self.marks.append((mark, kind))
                self.mains.append(0)
                mark = len(self.marks) - 1
        if tag == "form":
            self.marks.append((mark, "aside"))
            self.mains.append(0)
            mark = len(self.marks) - 1
        if tag in ("article", "main"):
            self.mains[mark] += 1
        place = len(self.stack)
        self.places.setdefault(tag, []).append(place)
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.parents) - 1
            self.bounds.append(place)
        if tag in CONTAINERS or tag in ("table", "ul", "ol", "dl"):
            self.borders.append(place)
        self.stack.append((tag, self.at))
        self.at = (container, no_content or bad, no_text or tag in NO_TEXT, in_article or tag == "article", mark)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end(self, tag: str, within: bool = False) -> None:
        """Closes the innermost open ``tag`` and what is open inside it; ``within``: not beyond a container or list. Only what is closed is gone through."""
        own = self.places.get(tag)
        if not own:
            return
        k = own[-1]
        if within and self.borders and self.borders[-1] > k or tag not in BLOCKS and self.bounds and self.bounds[-1] > k:
            return
        self.at = self.stack[k][1]
        for name, _ in self.stack[k:]:
            self.places[name].pop()
        del self.stack[k:]
        for ends in (self.bounds, self.borders):
            while ends and ends[-1] >= k:
                ends.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.line()
        self.tags += 1
        if tag not in VOID:
            self.end(tag)

    def handle_data(self, data: str) -> None:
        if not self.at[2]:
            self.text.append(data)
            if not self.places.get("a") and not self.at[1]:
                self.plain += len(data.strip())

    def read(self, html: str) -> list[tuple[str, int, int, int, bool, int]]:
        for a in range(0, len(html), 1 << 16):
            self.feed(html[a : a + (1 << 16)])
        self.close()
        self.line()
        return self.lines

    def left_out(self) -> list[bool]:
        """Of each mark whether its text is no content."""
        parents = [p for p, _ in self.marks]
        sizes, mains = [0] * len(parents), list(self.mains)
        for line in self.lines:
            if not line[4]:
                sizes[line[5]] += line[1]
        summed(sizes, parents)
        summed(mains, parents)
        out = [False] * len(parents)
        for k in range(1, len(parents)):
            most = sizes[k] >= (MARKED_ALL if self.marks[k][1] == "readers" else MARKED_HALF) * sizes[0]
            out[k] = out[parents[k]] or not (most and mains[k] == mains[0])
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolved with a Gaussian of so many lines."""
    reach = max(1, int(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, reach)
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def clusters(ratios: np.ndarray, share: float = THRESHOLD) -> list[tuple[int, int]]:
    """Ranges of lines whose smoothed ratio is over ``share`` of the standard deviation."""
    over = np.concatenate([[False], smoothed(ratios) > share * ratios.std(), [False]])
    if len(ratios) == 1:
        over[1] = ratios[0] > 0
    edges = np.nonzero(over[1:] != over[:-1])[0]
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def main_text(html: str | None) -> str:
    """The text of a page's content blocks in page order, joined by single spaces; empty if there is none."""
    if not html:
        return ""
    page = Page()
    lines = page.read(html)
    if not lines:
        return ""
    # the text of what is marked counts for nothing, unless it is most of the page's
    out = page.left_out()
    lines = [(*x[:4], x[4] or out[x[5]]) for x in lines]
    plain = np.array([0 if x[4] else x[1] for x in lines], np.float64)
    ratios = plain / np.array([max(1, x[2]) for x in lines])
    found = clusters(ratios)
    if not found:
        found = [(0, len(lines))] if plain.any() else []
    held = [i for a, b in found for i in range(a, b) if plain[i]]
    if not held:
        return ""
    of = [x[3] for x in lines]
    # lines of clusters in each container and below: a parent comes before its children
    n_held = [0] * len(page.parents)
    for i in held:
        n_held[of[i]] += 1
    summed(n_held, page.parents)
    # articles (main elements, if there are none) that hold a cluster's text are taken whole; text of clusters outside of them too, by its container
    inside = [c for c, n in enumerate(n_held) if n]
    kind = "article" if any(page.kinds[c] == "article" for c in inside) else "main"
    regions = {c for c in inside if page.kinds[c] == kind}
    within = below(regions, page.parents)
    loose = [i for i in held if not within[of[i]]]
    if not regions:
        # no such element: the innermost container that has all of the clusters' text
        regions = {max(c for c in inside if n_held[c] == len(held))}
    else:
        n_regions = [int(c in regions) for c in range(len(page.parents))]
        summed(n_regions, page.parents)
        regions |= {of[i] for i in loose if page.kinds[of[i]] not in ("html", "body") and not n_regions[of[i]]}
    taken, within = set(loose), below(regions, page.parents)
    return " ".join(x[0] for i, x in enumerate(lines) if not x[4] and (i in taken or within[of[i]]))


def summed(counts: list[int], parents: list[int]) -> None:
    """Adds the counts of all that is below to each container."""
    for c in range(len(parents) - 1, 0, -1):
        counts[parents[c]] += counts[c]


def below(regions: set[int], parents: list[int]) -> list[bool]:
    """Whether each container is one of ``regions`` or in one."""
    out = [False] * len(parents)
    for c, p in enumerate(parents):
        out[c] = c in regions or p >= 0 and out[p]
    return out


def extract(df: DataFrame, key: str = "page_id", html: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, ``also``, text, n_chars of every page of ``df``.

    Null and empty pages have an empty text; malformed markup is read as far as the parser gets; null
    keys and repeated rows stay; further columns are not read; an empty table gives an empty one.
    """
    columns = [f"k{i}" for i in range(1 + len(also))]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*columns, "text", "n_chars"])

        return each

    names = [key, *also]
    kinds = ", ".join(f"{c} {df.schema[n].dataType.simpleString()}" for c, n in zip(columns, names, strict=True))
    rows = df.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], F.col(html).alias("html"))
    out = map_batches(rows, make, f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "text", "n_chars")

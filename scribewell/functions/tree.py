"""Trees of web pages: tags and text as nodes, read in one pass over the page whatever its markup.

End tags that are left out are implied, formatting that was never ended goes on in the blocks that follow, and an end tag
without a start tag is passed over. Where an open element stands is looked up by its tag, so no step goes
through the stack, and deep nesting is flattened; a page takes time in proportion to its length.
"""

from __future__ import annotations

import re
from html import unescape

# Elements of HTML by what they mean for the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN = frozenset("title textarea".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: An element that begins ends these, unless one of the others has begun since.
ENDS = {
    "li": (("li",), "list"),
    "dt": (("dt", "dd"), "list"),
    "dd": (("dt", "dd"), "list"),
    "option": (("option",), "cell"),
    "td": (("td", "th"), "row"),
    "th": (("td", "th"), "row"),
    "tr": (("tr",), "table"),
    "tbody": (("tbody", "thead", "tfoot"), "table"),
    "thead": (("tbody", "thead", "tfoot"), "table"),
    "tfoot": (("tbody", "thead", "tfoot"), "table"),
}
BOUNDS = {
    "list": frozenset("ul ol menu dl dir article aside blockquote body details fieldset figure footer form header html main nav section table td th".split()),
    "cell": frozenset("caption html table td th template button object".split()),
    "row": frozenset("tr table html".split()),
    "table": frozenset("table html".split()),
}
#: The bounds that an element is one of.
_BOUNDS_OF = {tag: tuple(kind for kind, tags in BOUNDS.items() if tag in tags) for tags in BOUNDS.values() for tag in tags}
_IN_TABLES = frozenset("caption tbody td tfoot th thead tr table".split())
TEXT = "#text"
#: Elements deeper than this become children of the one there. Page trees of browsers have such a bound too.
DEEPEST = 200
#: Tags of a node's path.
PATH_TAGS = 16

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?)""")


class Tree:
    """Nodes of a page by number, in the order in which they begin; node 0 holds all others.

    Of node k: ``tags[k]``, ``attributes[k]``, ``parents[k]``, ``depths[k]``, ``texts[k]`` (of text nodes), and
    where its content and the whole of it stand in the page (``inner[k]``, ``outer[k]``).
    """

    def __init__(self, html: str):
        self.html = html
        self.tags, self.attributes, self.parents, self.depths, self.texts = ["#page"], [{}], [-1], [0], [""]
        self.inner, self.outer = [[0, len(html)]], [[0, len(html)]]
        self.stack, self.places = [0], {}  # open nodes, and where each tag stands in the stack
        self.bounds: dict[str, list[int]] = {k: [] for k in BOUNDS}
        self.unended: dict[str, dict] = {}  # formatting that goes on where text comes next
        self._read()
        self.children: list[list[int]] = [[] for _ in self.tags]
        for k, parent in enumerate(self.parents[1:], 1):
            self.children[parent].append(k)

    def _read(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:], at)
                break
            if m.start() > at:
                self._text(html[at : m.start()], at)
            begin, at = m.start(), m.end()
            end_, name, comment, _ = m.groups()
            if comment:
                at = html.find("-->", begin + 2) + 3
            elif name is None:
                at = html.find(">", at) + 1
            else:
                attributes, at, closed = self._attributes(at)
                if not closed:
                    break  # a tag that the page's end cuts off
                name = name.lower()
                if end_:
                    self._end(name, begin, at)
                else:
                    at = self._start(name, attributes, begin, at)
                continue
            if at < begin + 2:
                break  # no end to be found
        self._pop(1, n, n)

    def _attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        out: dict[str, str] = {}
        while (m := _ATTRIBUTE.match(self.html, at)) is not None:
            at = m.end()
            if m[1]:
                return out, at, True
            value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[5] or ""
            out.setdefault(m[2].lower(), unescape(value))
        return out, at, False

    def _add(self, tag: str, attributes: dict, begin: int, at: int, text: str = "") -> int:
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.parents.append(self.stack[-1])
        self.depths.append(len(self.stack))
        self.texts.append(text)
        self.inner.append([at, at])
        self.outer.append([begin, at])
        return len(self.tags) - 1

    def _push(self, tag: str, attributes: dict, begin: int, at: int) -> None:
        k = self._add(tag, attributes, begin, at)
        if len(self.stack) > DEEPEST:
            return
        place = len(self.stack)
        self.places.setdefault(tag, []).append(place)
        for kind in _BOUNDS_OF.get(tag, ()):
            self.bounds[kind].append(place)
        self.stack.append(k)

    def _pop(self, place: int, end: int, after: int) -> None:
        """Ends all open nodes from ``place`` on; formatting among those that no end tag named goes on later."""
        for p in range(len(self.stack) - 1, place - 1, -1):
            k = self.stack.pop()
            tag = self.tags[k]
            self.places[tag].pop()
            for kind in _BOUNDS_OF.get(tag, ()):
                self.bounds[kind].pop()
            self.inner[k][1], self.outer[k][1] = end, after if p == place else end
            if tag in FORMATTING:
                self.unended.setdefault(tag, self.attributes[k])
            elif tag in ("td", "th", "caption"):
                self.unended.clear()

    def _innermost(self, tag: str, bound: str) -> int | None:
        """The place of the innermost open ``tag``, if no element of ``bound`` has begun since."""
        own, bounds = self.places.get(tag), self.bounds[bound]
        return own[-1] if own and (not bounds or bounds[-1] <= own[-1]) else None

    def _text(self, text: str, at: int) -> None:
        text = unescape(text)
        if self.unended and not text.isspace():
            self._go_on(at)
        if self.tags[-1] == TEXT and self.parents[-1] == self.stack[-1]:
            self.texts[-1] += text
            return
        self._add(TEXT, {}, at, at, text)

    def _go_on(self, at: int) -> None:
        unended, self.unended = self.unended, {}
        for tag, attributes in unended.items():
            if not self.places.get(tag):
                self._push(tag, attributes, at, at)

    def _start(self, tag: str, attributes: dict, begin: int, at: int) -> int:
        if tag in BLOCKS and (place := self._innermost("p", "cell")) is not None:
            self._pop(place, begin, begin)
        if tag in HEADINGS and self.tags[self.stack[-1]] in HEADINGS:
            self._pop(len(self.stack) - 1, begin, begin)
        if tag in ENDS:
            others, bound = ENDS[tag]
            if (place := max((p for t in others if (p := self._innermost(t, bound)) is not None), default=None)) is not None:
                self._pop(place, begin, begin)
        if tag == "a" and (place := self._innermost("a", "cell")) is not None:
            self._end("a", begin, begin)
        if tag not in BLOCKS and self.unended and tag not in RAW:
            self.unended.pop("a" if tag == "a" else "", None)
            self._go_on(begin)
        if tag in VOID:
            self._add(tag, attributes, begin, at)
            return at
        self._push(tag, attributes, begin, at)
        if tag in RAW or tag in PLAIN:
            # up to its end tag there are no tags
            m = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(self.html, at)
            end = m.start() if m else len(self.html)
            if tag in PLAIN and end > at:
                self._add(TEXT, {}, at, end, unescape(self.html[at:end]))
            after = self.html.find(">", end) + 1 or len(self.html)
            if self.tags[self.stack[-1]] == tag:
                self._pop(len(self.stack) - 1, end, after)
            return after
        return at

    def _end(self, tag: str, begin: int, at: int) -> None:
        place = self._innermost(tag, "table" if tag in _IN_TABLES else "cell")
        if tag in FORMATTING:
            # a block that began inside isn't ended with it
            last_block = max((self.places[t][-1] for t in ("p", "li", "div", "blockquote") if self.places.get(t)), default=0)
            if place is None or place < last_block:
                self.unended.pop(tag, None)
                return
        if place is not None:
            self._pop(place, begin, at)
            self.unended.pop(tag, None)

    def text_of(self, k: int) -> str:
        """All text in a node but that of elements without any."""
        out, open_ = [], [k]
        while open_:
            k = open_.pop()
            out.append(self.texts[k])
            open_.extend(reversed(self.children[k]))
        return "".join(out)

    def rows(self) -> list[tuple[int, int, int, str, str, str]]:
        """(node, parent, depth, path, tag, text) of all nodes but blank text; a path has the last PATH_TAGS tags."""
        paths, out = [[]], []
        for k in range(1, len(self.tags)):
            paths.append([*paths[self.parents[k]], self.tags[k]][-PATH_TAGS:] if self.tags[k] != TEXT else [])
            if self.tags[k] != TEXT or not self.texts[k].isspace():
                own = paths[k] if self.tags[k] != TEXT else paths[self.parents[k]]
                out.append((k, self.parents[k], self.depths[k], "/".join(own), self.tags[k], self.texts[k]))
        return out

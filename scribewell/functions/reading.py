"""What of a page's tree is worth reading, and the same as markdown."""

from __future__ import annotations

import re

from scribewell.functions.tree import BLOCKS, HEADINGS, RAW, TEXT, Tree

# Elements that are no part of an article where no article element says so, and those that have no text.
ASIDE = frozenset("head nav header footer aside form dialog menu".split())
SILENT = RAW | frozenset("head title noscript template svg math object canvas audio video map select datalist button textarea input".split())
CONTAINERS = frozenset("main section article div td blockquote center".split())
#: A paragraph counts from this many characters on; what it is worth goes to so many ancestors, and sections stay from this share of the best one's score on.
PARAGRAPH_LEAST, ANCESTORS, SECTION_SHARE = 25, 5, 0.2
# Signs of a text that markdown would read, anywhere and at the beginning of a line.
_SIGNS = re.compile(r"[\\*_`\[\]]")
_LINE_SIGNS = re.compile(r"^(?:(?=-|=|>|\+ |#{1,6} |~~~)|(\d+)(?=\. ))", re.MULTILINE)
_BLANKS = re.compile(r"[ \t\r\n\f]+")
#: A line break, until blanks are made one.
_BREAK = "\x01"
#: Lists and quotes in each other that are marked as such; what is deeper stands at the last mark.
MARKED_DEEP = 12


def is_block(tree: Tree) -> list[bool]:
    """Of every node whether it is a block or has one in it."""
    out = [tag in BLOCKS for tag in tree.tags]
    for k in range(len(out) - 1, 0, -1):
        if out[k]:
            out[tree.parents[k]] = True
    return out


class Scores:
    """What parts of a page are worth as an article."""

    def __init__(self, tree: Tree):
        self.tree = tree
        n = len(tree.tags)
        aside, linked = [False] * n, [False] * n
        for k in range(1, n):
            p, tag, names = tree.parents[k], tree.tags[k], tree.attributes[k]
            hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
            aside[k] = aside[p] or tag in ASIDE or tag in SILENT or hidden
            linked[k] = linked[p] or tag == "a"
        self.aside = aside
        # characters, those in links, and commas of every node, from the leaves up
        size, links, commas = [0] * n, [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if tree.tags[k] == TEXT and not aside[k]:
                text = _BLANKS.sub(" ", tree.texts[k])
                size[k] = len(text) if text != " " else 0
                links[k], commas[k] = size[k] * linked[k], text.count(",")
            p = tree.parents[k]
            size[p], links[p], commas[p] = size[p] + size[k], links[p] + links[k], commas[p] + commas[k]
        blocks = is_block(tree)
        plain = [not any(blocks[c] for c in tree.children[k]) for k in range(n)]
        #: Points of paragraphs, and of each container those of the paragraphs below it.
        self.points, self.sums, self.below = [0.0] * n, [0.0] * n, [0.0] * n
        for k in range(1, n):
            tag = tree.tags[k]
            if aside[k] or size[k] < PARAGRAPH_LEAST or not (tag in ("p", "pre") or tag in CONTAINERS and plain[k]):
                continue
            self.points[k] = 1 + commas[k] + min(size[k] // 100, 3)
            own = tag in CONTAINERS and tag != "div"
            p = k if own else tree.parents[k]
            for level in range(ANCESTORS):
                if p <= 0:
                    break
                self.sums[p] += self.points[k] / (1 if level == 0 else 2 if level == 1 else 3 * level)
                p = tree.parents[p]
        for k in range(n):
            self.sums[k] *= 1 - links[k] / max(size[k], 1)
            self.points[k] *= 1 - links[k] / max(size[k], 1)
        for k in range(n - 1, 0, -1):
            self.below[k] += self.points[k]
            self.below[tree.parents[k]] += self.below[k]

    def articles(self) -> list[int]:
        """The article element that is worth most, of those in no other one; the first of equals."""
        tree, inside, found = self.tree, [False] * len(self.tree.tags), []
        for k in range(1, len(inside)):
            inside[k] = inside[tree.parents[k]] or tree.tags[k] == "article"
            if tree.tags[k] == "article" and not inside[tree.parents[k]]:
                found.append(k)
        return [max(found, key=lambda k: (self.below[k], -k))] if found else []

    def sections(self) -> list[int]:
        """The container that paragraphs make worth most, and those beside it that reach a share of it; where none does, the page's own paragraphs."""
        tree = self.tree
        able = [k for k in range(1, len(tree.tags)) if tree.tags[k] in CONTAINERS and not self.aside[k] and self.sums[k] > 0]
        if not able:
            return [k for k in range(1, len(tree.tags)) if self.points[k] > 0]
        best = max(able, key=lambda k: (self.sums[k], tree.depths[k], -k))
        least = self.sums[best] * SECTION_SHARE
        return [k for k in tree.children[tree.parents[best]] if not self.aside[k] and (k == best or tree.tags[k] in CONTAINERS and self.sums[k] >= least or tree.tags[k] in ("p", "pre") and self.points[k] > 0 and self.points[k] >= least)]


def chosen(tree: Tree, elements: bool = True) -> list[int]:
    """The nodes that are a page's article: its article element (unless ``elements`` is false), or else the sections that score."""
    scores = Scores(tree)
    return (scores.articles() if elements else []) or scores.sections()


def slices(tree: Tree, nodes: list[int]) -> str:
    """The source of what stands in ``nodes``, a line for each."""
    spans = [tree.inner[k] if tree.tags[k] in CONTAINERS else tree.outer[k] for k in nodes]
    return "\n".join(tree.html[a:b] for a, b in spans)


class Markdown:
    """Nodes of a tree as markdown: headings, lists, emphasis, links, images, rules, quotes, code and tables."""

    def __init__(self, tree: Tree):
        self.tree, self.blocks, self.deep = tree, is_block(tree), 0

    def of(self, nodes: list[int]) -> str:
        """What stands in ``nodes``, one block after the other."""
        out = []
        for k in nodes:
            out += [text for _, text in (self.inside(k) if k == 0 or self.tree.tags[k] in CONTAINERS else self.block(k) if self.blocks[k] else self.inside(k))]
        return "\n\n".join(out)

    def inside(self, k: int) -> list[tuple[str, str]]:
        """(kind, text) of the blocks in a node; what stands between them is a paragraph."""
        out: list[tuple[str, str]] = []
        inline: list[str] = []

        def flush() -> None:
            if text := paragraph("".join(inline)):
                out.append(("text", text))
            inline.clear()

        for child in self.tree.children[k]:
            if self.blocks[child]:
                flush()
                out.extend(self.block(child))
            else:
                inline.append(self.inline(child, frozenset()))
        flush()
        return out

    def block(self, k: int) -> list[tuple[str, str]]:
        tag = self.tree.tags[k]
        if tag in SILENT:
            return []
        if tag in HEADINGS:
            text = " ".join(text.replace("\n", " ") for _, text in self.inside(k))
            return [("text", f"{'#' * int(tag[1])} {text}")] if text else []
        if tag == "hr":
            return [("text", "* * *")]
        if tag == "pre":
            return self.fence(k)
        if tag in ("blockquote", "ul", "ol", "menu", "dir", "li"):
            if self.deep == MARKED_DEEP:
                return self.inside(k)
            self.deep += 1
            out = self.quote(k) if tag == "blockquote" else [("list", self.item("*   ", k))] if tag == "li" else self.items(k, tag == "ol")
            self.deep -= 1
            return out
        if tag == "table" and (rows := self.table(k)):
            return [("text", rows)]
        return self.inside(k)

    def quote(self, k: int) -> list[tuple[str, str]]:
        text = "\n\n".join(text for _, text in self.inside(k))
        return [("text", re.sub(r"^(.?)", lambda m: f"> {m[1]}" if m[1] else ">", text, flags=re.MULTILINE))] if text else []

    def items(self, k: int, numbered: bool) -> list[tuple[str, str]]:
        start = self.tree.attributes[k].get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        out: list[str] = []
        for child in self.tree.children[k]:
            if self.tree.tags[child] == TEXT and self.tree.texts[child].isspace():
                continue
            if self.tree.tags[child] in ("ul", "ol") and out:
                # a list that stands beside its item
                out[-1] += "".join("\n" + indented(text) for _, text in self.block(child))
                continue
            out.append(self.item(f"{number}. ".ljust(4) if numbered else "*   ", child))
            number += 1
        return [("list", "\n".join(out))] if out else []

    def item(self, mark: str, k: int) -> str:
        parts = self.inside(k) if self.tree.tags[k] != TEXT else [("text", paragraph(self.inline(k, frozenset())))]
        text = ""
        for kind, part in parts:
            text += ("\n" if kind == "list" else "\n\n") * bool(text) + part
        return mark + indented(text)[4:] if text else mark.rstrip()

    def fence(self, k: int) -> list[tuple[str, str]]:
        code = self.tree.text_of(k).strip("\n").rstrip()
        names = " ".join(self.tree.attributes[c].get("class", "") for c in (k, *self.tree.children[k]))
        language = m[1] if (m := re.search(r"(?:^|\s)lang(?:uage)?-(\S+)", names)) else ""
        mark = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", code)), default=0))
        return [("text", f"{mark}{language}\n{code}\n{mark}")] if code else []

    def table(self, k: int) -> str:
        """A table whose first row has headings only; other tables are read cell by cell."""
        tree, rows = self.tree, []
        open_ = list(reversed(tree.children[k]))
        while open_:
            c = open_.pop()
            if tree.tags[c] == "tr":
                cells = [x for x in tree.children[c] if tree.tags[x] in ("td", "th")]
                if cells:
                    rows.append(cells)
            elif tree.tags[c] in ("thead", "tbody", "tfoot"):
                open_ += reversed(tree.children[c])
        if not rows or any(tree.tags[c] != "th" for c in rows[0]):
            return ""
        width = max(map(len, rows))
        if width * len(rows) > 4 * sum(map(len, rows)):
            return ""
        cell = lambda c: " ".join(text for _, text in self.inside(c)).replace("|", r"\|").replace("\n", " ")
        lines = [[*map(cell, own), *[""] * (width - len(own))] for own in rows]
        return "\n".join("| " + " | ".join(own) + " |" for own in [lines[0], ["---"] * width, *lines[1:]])

    def inline(self, k: int, around: frozenset) -> str:
        tree, tag = self.tree, self.tree.tags[k]
        if tag == TEXT:
            return _SIGNS.sub(r"\\\g<0>", tree.texts[k].replace(_BREAK, ""))
        if tag == "br":
            return _BREAK
        names = tree.attributes[k]
        if tag == "img":
            return f"![{spaced(names.get('alt', ''))}]({names['src'].strip()}{titled(names)})" if names.get("src", "").strip() else ""
        if tag in SILENT:
            return ""
        if tag in ("code", "kbd", "samp", "tt"):
            code = spaced(tree.text_of(k))
            mark = "`" * (1 + max((len(x) for x in re.findall("`+", code)), default=0))
            pad = " " if code[:1] == "`" or code[-1:] == "`" else ""
            return f"{mark}{pad}{code}{pad}{mark}" if code.strip() else code
        # emphasis in emphasis of its kind, and links in links, say nothing new
        kind = {"b": "**", "strong": "**", "i": "_", "em": "_", "a": "a"}.get(tag, "")
        inner = "".join(self.inline(c, around | {kind}) for c in tree.children[k])
        core = inner.strip(" \t\r\n\f" + _BREAK)
        if not kind or kind in around or not core:
            return inner if core or kind != "a" else ""
        at = inner.index(core)
        if kind == "a":
            href = names.get("href", "").strip()
            return f"{inner[:at]}[{core}]({href}{titled(names)}){inner[at + len(core) :]}" if href else inner
        return f"{inner[:at]}{kind}{core}{kind}{inner[at + len(core) :]}"


def spaced(text: str) -> str:
    return _BLANKS.sub(" ", text)


def titled(names: dict) -> str:
    title = spaced(names.get("title", "")).strip().replace('"', r"\"")
    return f' "{title}"' if title else ""


def paragraph(inline: str) -> str:
    """Inline text with one blank for several, line breaks, and signs at the beginning of a line that markdown would read."""
    text = re.sub(f" ?{_BREAK} ?", "  \n", spaced(inline).strip(" " + _BREAK))
    return _LINE_SIGNS.sub(lambda m: f"{m[1] or ''}\\", text)


def indented(text: str) -> str:
    return re.sub(r"^(?=.)", "    ", text, flags=re.MULTILINE)

"""Trees of pages against literal ones, and that their time grows with the page only."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribewell.functions.reading import Markdown, chosen, slices
from scribewell.functions.tree import DEEPEST, TEXT, Tree
from scribewell.plans import distill


def outline(html):
    """A tree as nested lists: [tag, ...], and text as it is."""
    tree = Tree(html)
    return [of(tree, k) for k in tree.children[0]]


def of(tree, k):
    return tree.texts[k] if tree.tags[k] == TEXT else [tree.tags[k], *[of(tree, c) for c in tree.children[k]]]


def test_literal_trees():
    cases = {
        "<p>a<b>b</b>c</p>d": [["p", "a", ["b", "b"], "c"], "d"],
        "<p>a<p>b<div>c</div></p>d": [["p", "a"], ["p", "b"], ["div", "c"], "d"],
        "<ul><li>a<ul><li>b</ul><li>c</ul>": [["ul", ["li", "a", ["ul", ["li", "b"]]], ["li", "c"]]],
        "<table><tr><td>a<table><tr><td>b</table><td>c<tr><th>d</table>e": [["table", ["tr", ["td", "a", ["table", ["tr", ["td", "b"]]]], ["td", "c"]], ["tr", ["th", "d"]]], "e"],
        "<dl><dt>a<dd>b<dt>c</dl>": [["dl", ["dt", "a"], ["dd", "b"], ["dt", "c"]]],
        # formatting that isn't ended goes on in the next block, and ends with its own tag
        "<p><b>a<br><p>b</b>c<p>d": [["p", ["b", "a", ["br"]]], ["p", ["b", "b"], "c"], ["p", "d"]],
        "<b><i>x</b>y</i>z": [["b", ["i", "x"]], ["i", "y"], "z"],
        "<a href=1>x<a href=2>y</a>z": [["a", "x"], ["a", "y"], "z"],
        "<table><tr><td><b>x<td>y</table>z": [["table", ["tr", ["td", ["b", "x"]], ["td", "y"]]], "z"],
        # end tags without a start, and of another cell
        "a</p></div>b</b>": ["ab"],
        "<div><table><tr><td>a</div>b</table>c</div>d": [["div", ["table", ["tr", ["td", "ab"]]], "c"], "d"],
        # raw text, comments, declarations, what is cut off, and signs that begin no tag
        "<script>if (a<b) '</p>'</script>x<!-- <p> -->y<!doctype html>z<?php ?>": [["script"], "xyz"],
        "<title>a <b> &amp; c</title><textarea><p></textarea>x": [["title", "a <b> & c"], ["textarea", "<p>"], "x"],
        "a < b <3 <x-y>c</x-y> &lt;p&gt; &#8217;": ["a < b <3 ", ["x-y", "c"], " <p> ’"],
        "<p>a<script>b": [["p", "a", ["script"]]],
        "a<!-- b": ["a"],
        "a<p class='x": ["a"],
        "<h1>a<h2>b</h2>": [["h1", "a"], ["h2", "b"]],
        "": [],
    }
    assert {html: outline(html) for html in cases} == cases


def test_attributes_and_places():
    tree = Tree("<DIV Class=a&amp;b id='c' id=d hidden data-x = \"1>2\" /><p>x</p>")
    assert tree.attributes[1] == {"class": "a&b", "id": "c", "hidden": "", "data-x": "1>2"}
    p = tree.tags.index("p")
    assert tree.html[slice(*tree.inner[p])] == "x" and tree.html[slice(*tree.outer[p])] == "<p>x</p>"


def test_nodes_table(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<li>b</ul>\n<p><b>x<p>y"), (2, None), (3, "")], "page_id long, html string")
    rows = [tuple(r)[1:] for r in distill.page_nodes(pages).orderBy("page_id", "node").collect()]
    assert [r[3:] for r in rows] == [("ul", "ul", ""), ("ul/li", "li", ""), ("ul/li", TEXT, "a"), ("ul/li", "li", ""), ("ul/li", TEXT, "b"), ("p", "p", ""), ("p/b", "b", ""), ("p/b", TEXT, "x"), ("p", "p", ""), ("p/b", "b", ""), ("p/b", TEXT, "y")]
    assert [r[:3] for r in rows[:3]] == [(1, 0, 1), (2, 1, 2), (3, 2, 3)]


HOSTILE = ["<script>x", "<nav>x", "<a href=q>x", "<b>x<p>", "<ul><li>x", "<table><tr><td>", "<<", "<a ", "<a b='", "<!--", "<!x", "<font color=1>x<p>", "<div>x", "<span><p>", "<td>x", "<b><i><a href=x><div>", "<blockquote>x\n", "<title>", "</p>", "<article>x", "<li><div>", "<p>" + " " * 50]


@pytest.mark.parametrize("piece", HOSTILE)
def test_a_megabyte_of_broken_markup(piece):
    html = piece * (1_000_000 // len(piece))
    began = time.process_time()
    tree = Tree(html)
    slices(tree, chosen(tree))
    text = Markdown(tree).of([0])
    # some two seconds where the machine is not shared; what is quadratic takes minutes
    assert time.process_time() - began < 20
    assert len(text) < 8 * len(html) and max(tree.depths) <= DEEPEST + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "<a href=x>", "</a>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<br>", "<h1>", "<pre>", "<article>", "</article>", "x", " y ", "&amp;", "<script>", "</script>"]), max_size=40))
def test_any_markup_keeps_its_text(pieces):
    html = "".join(pieces)
    tree = Tree(html)
    plain, raw = "", False
    for piece in pieces:
        raw = piece != "</script>" if raw else piece == "<script>"
        plain += "" if raw or piece[0] == "<" else piece.replace("&amp;", "&")
    assert "".join(tree.text_of(0).split()) == "".join(plain.split())
    # parents come before their children and hold them
    for k in range(1, len(tree.tags)):
        assert tree.parents[k] < k and tree.depths[k] == tree.depths[tree.parents[k]] + 1
    letters = lambda text: [c for c in text if c in "xy&"]
    links = Markdown(tree).of([0]).replace("](x)", "]")
    assert letters(links) == letters(plain)


def test_read_gives_all_in_one(spark):
    long = "A paragraph that goes on for a while, with commas, and with more than enough words."
    html = f"<title>T &amp; U</title><nav>n</nav><article><h1>H</h1><p>{long}</p></article>"
    rows = spark.createDataFrame([(html,), ("<p>x</p>",), (None,), ("",)], "html string").select(distill.read(F.col("html")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("T & U", True, f"# H\n\n{long}"), ("", False, ""), (None, None, None), ("", False, "")]

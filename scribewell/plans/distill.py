"""Pages to titled, length-capped markdown, prompts for a text model, and its answers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribewell.functions.reading import Markdown, chosen, slices
from scribewell.functions.tree import Tree
from scribewell.functions.web import capturable
from scribewell.operators.providers import TextModel, answered

# The cap and the prompts.
LINES = 40
PROMPT = "Summarize the following text.:\n\n"
TRANSLATE = "日本語に翻訳してください:\n\n"
#: A node of a page: its number and its parent's (0 is the page), how deep it stands, the tags down to it, its own, and the text of text nodes.
NODE = "node int, parent int, depth int, path string, tag string, text string"
#: What a page is read for.
PAGE = "title string, found boolean, markdown string"


def _of_texts(column: pa.Array, value: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    return pa.array([None if x is None else value(x) for x in column.to_pylist()], kind)


def _read(html: str) -> dict:
    tree = Tree(html)
    nodes = chosen(tree)
    titles = [tree.text_of(k) for k, tag in enumerate(tree.tags) if tag == "title"]
    return {"title": titles[0] if titles else "", "found": slices(tree, nodes) != "", "markdown": Markdown(tree).of(nodes)}


def _nodes(html: str) -> list[dict]:
    return [dict(zip(("node", "parent", "depth", "path", "tag", "text"), row, strict=True)) for row in Tree(html).rows()]


def _slices(html: str, elements: bool) -> str:
    tree = Tree(html)
    return slices(tree, chosen(tree, elements))


def article(html: Column) -> Column:
    """A page's main part: what its article element holds, the best of several, or else the sections that score; empty if there is none.

    Articles in an article are part of it; the first one wins among equals. Null stays null.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return _of_texts(column, lambda x: _slices(x, True), pa.string())

    return run(html)


def scored(html: Column) -> Column:
    """The sections of a page that read like an article, whatever its article elements: a container that the paragraphs in it make worth most, and those beside it."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return _of_texts(column, lambda x: _slices(x, False), pa.string())

    return run(html)


def markdown(html: Column) -> Column:
    """Markdown of a part of a page: headings, lists in lists, emphasis, links, images, rules, quotes, code and tables; signs that markdown would read are escaped.

    A table is one if its first row has headings only; cells of others become paragraphs. Null stays null.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return _of_texts(column, lambda x: Markdown(Tree(x)).of([0]), pa.string())

    return run(html)


def read(html: Column) -> Column:
    """A page's title, whether it has an article, and this as markdown, from one tree."""

    @F.arrow_udf(f"struct<{PAGE.replace(' ', ':').replace(',:', ',')}>")
    def run(column: pa.Array) -> pa.Array:
        return _of_texts(column, _read, pa.struct([("title", pa.string()), ("found", pa.bool_()), ("markdown", pa.string())]))

    return run(html)


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and the nodes of every page's tree, without blank text; pages without html have none."""
    kind = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("tag", pa.string()), ("text", pa.string())])

    @F.arrow_udf(f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")
    def run(column: pa.Array) -> pa.Array:
        return _of_texts(column, _nodes, pa.list_(kind))

    return pages.select(key, F.explode(run(F.col(html))).alias("of")).select(key, "of.*")


def head_lines(text: Column, most: int = LINES) -> Column:
    """The first lines of a text; a text of fewer lines is the same as before."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")


def prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT), text)


def translate_prompt(language: Column, summary: Column) -> Column:
    """The text that a translating model is asked; null for other languages than Japanese."""
    return F.when(language == "japanese", F.concat(F.lit(TRANSLATE), summary))


def titled(name: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("# ["), name, F.lit("]("), url, F.lit(")\n\n"), body)


def status(html: Column, has_provider: Column) -> Column:
    """Why a page has no summary, or ``ok``: checks in the order in which they stop the work."""
    return F.when(html.isNull() | (html == ""), "no_content").when(article(html) == "", "no_article").when(~has_provider, "no_provider").otherwise("ok")


def failure_text(state: Column) -> Column:
    """What is shown instead of a summary; null if all went well."""
    return F.when(state != "ok", F.concat(F.lit("Failed to summarize: "), state))


def distilled(pages: DataFrame) -> DataFrame:
    """page_id, url, title and the capped markdown of every page that can be captured and has an article.

    A page is read once, in Arrow batches and without a shuffle; the cap comes before any model is asked.
    """
    kept = pages.where(capturable(F.col("url")) & F.col("html").isNotNull()).select("page_id", "url", read(F.col("html")).alias("page"))
    # a filter would be pushed below the projection and read the page twice
    found = F.filter(F.array(head_lines(F.col("page.markdown"))), lambda x: x != "")
    return kept.select("page_id", "url", F.col("page.title").alias("title"), F.explode(found).alias("body"))


def summarized(pages: DataFrame, summarizers: list[Callable[[], TextModel]], translators: list[Callable[[], TextModel]]) -> DataFrame:
    """page_id, text, status of every page (page_id, url, html, language): its summary under a linked title, in Japanese if that is the language.

    The summary of a page's markdown goes to the translating model for Japanese readers only. Where a model fails, the text says so and the
    status too; pages that can't be captured or have no article are left out, as in :func:`distilled`.
    """
    done = distilled(pages)
    asked = done.select("page_id", prompt(F.col("body")).alias("prompt"))
    first = answered(asked, summarizers).select("page_id", F.col("answer").alias("summary"), F.col("status").alias("summary_status"))
    language = pages.select("page_id", "language")
    second = first.join(language, "page_id").select("page_id", translate_prompt(F.col("language"), F.col("summary")).alias("prompt"))
    second = answered(second, translators).select("page_id", F.col("answer").alias("translated"), F.col("status").alias("translated_status"))
    both = done.select("page_id", "title", "url").join(first, "page_id").join(second, "page_id")
    status_ = F.when(F.col("summary_status") != "ok", F.col("summary_status")).when(~F.col("translated_status").isin("ok", "skipped"), F.col("translated_status")).otherwise("ok")
    text = F.when(status_ == "ok", titled(F.col("title"), F.col("url"), F.coalesce("translated", "summary"))).otherwise(failure_text(status_))
    return both.select("page_id", text.alias("text"), status_.alias("status"))

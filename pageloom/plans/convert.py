"""Pages to Markdown: the whole chain from captured HTML to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.operators.content import content_html, main_content, page_nodes
from pageloom.operators.markdown import to_markdown
from pageloom.sources.dom import page_markdown


def pages_to_markdown(pages: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """``(page_id, url, markdown)`` of the main content of every captured page."""
    return to_markdown(main_content(page_nodes(pages), keep_media=keep_media))


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """``(page_id, url, markdown)`` of the whole body, as it is.

    Equal to ``to_markdown(whole_body(page_nodes(pages, noise=True)))``, for a small part of its time on small pages.
    """
    return page_markdown(pages)


def pages_to_content(pages: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """``(page_id, url, html)``: the cleaned main content as HTML."""
    return content_html(main_content(page_nodes(pages), keep_media=keep_media))


def result_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """``(site, url, markdown, depth, path)`` of crawl results.

    Only reached pages are parsed; a page reached by several crawls is parsed once.
    """
    reached = pages.join(results.select("page_id").distinct(), "page_id", "left_semi")
    bodies = pages_to_markdown(reached).select("page_id", "markdown")
    return results.join(bodies, "page_id").select("site", "url", "markdown", "depth", "path")

"""Crawl results against the store: convert again only what has expired, and keep it for a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators import store
from pageloom.plans.config import RESULT_TTL_HOURS
from pageloom.plans.convert import pages_to_markdown
from pageloom.plans.crawl import incremental_frontier


def due_results(results: DataFrame, held: DataFrame, as_of: Column) -> DataFrame:
    """Crawl results ``(site, url, page_id, ...)`` whose URL has no live entry in the store ``held``."""
    # Keys and times only: stored values take no part.
    narrow = held.select("key", F.lit("").alias("value"), "written_at", "expires_at")
    return incremental_frontier(results, store.live(narrow, as_of).select("key"))


def refresh(
    pages: DataFrame, results: DataFrame, held: DataFrame, as_of: Column, ttl_hours: float = RESULT_TTL_HOURS
) -> DataFrame:
    """Store rows to append: the Markdown of all due results, written now.

    Only pages of due results are parsed.  A URL that several crawls reached is
    written once.
    """
    due = due_results(results, held, as_of).select("url", "page_id").distinct()
    html = pages.join(due.select("page_id"), "page_id", "left_semi")
    bodies = pages_to_markdown(html).select("page_id", F.col("markdown").alias("value"))
    written = due.join(bodies, "page_id").select(F.col("url").alias("key"), "value")
    return store.entries(written, as_of, ttl_hours)

"""The frontier of a crawl as tables: levels of URLs, and the set already visited.

Rows are keyed by ``(site, url)``; one site is one crawl.  ``path`` is the list
of link positions that led to a URL, so the order of paths within a depth is the
order of discovery, without any global numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import normalize_url

KEY = ["site", "url"]


def seed_level(seeds: DataFrame) -> DataFrame:
    """First level from ``seeds(site, start_url)``; malformed start URLs are left out."""
    return (
        seeds.selectExpr("site", f"{normalize_url('start_url')} AS url")
        .where("url IS NOT NULL")
        .distinct()
        .selectExpr("site", "url", "0 AS depth", "cast(array() AS array<int>) AS path",
                    "string(NULL) AS via")
    )


def candidate_links(level: DataFrame, edges: DataFrame) -> DataFrame:
    """What the links of ``level`` lead to, each target once, by its first discovery.

    ``level`` has every ``(site, url)`` once, so the join does not multiply hot
    pages; a popular target is reduced on the map side by the aggregate.
    """
    found = level.join(edges.select("url", "pos", "link"), "url").selectExpr(
        "site", "link", "depth + 1 AS depth",
        "struct(concat(path, array(pos)) AS path, url AS via) AS first",
    )
    return (
        found.groupBy("site", F.col("link").alias("url"))
        .agg(F.min("depth").alias("depth"), F.min("first").alias("first"))
        .select("site", "url", "depth", "first.path", "first.via")
    )


def frontier_step(level: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Next level: link targets that are neither visited nor queued.  Both sides are unique."""
    return candidate_links(level, edges).join(visited.select(KEY), KEY, "left_anti")


def visited_flag(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Adds ``norm_url`` and ``is_visited`` to ``urls(url)``; a malformed URL is not visited.

    ``visited`` holds normalised URLs, each once.
    """
    known = visited.select(F.col("url").alias("norm_url"), F.lit(True).alias("_seen"))
    return (
        urls.selectExpr("*", f"{normalize_url('url')} AS norm_url")
        .join(known, "norm_url", "left")
        .withColumn("is_visited", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def fetch_outcome(level: DataFrame, captured: DataFrame) -> DataFrame:
    """Adds ``page_id`` and ``fetched`` to frontier rows; a miss gives no result and no links."""
    known = level.join(captured.select("url", "page_id"), "url", "left").withColumn("fetched", F.col("page_id").isNotNull())
    return known.select(*level.columns, "page_id", "fetched")

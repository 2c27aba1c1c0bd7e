"""Crawl closure over captured pages: breadth first, one round of joins per depth.

Depth is the least number of links from the start.  Each round is written to
shared storage, which keeps plans short and lets the crawl survive lost
executors.  HTML is read once, to get the links; links, captures and the visited
set are stored by URL.  A round of a single crawl shuffles the targets of its own
links and nothing else: it reads its level from the visited set, joins links,
visited set and captures where they lie, and appends what it found as files of
its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import literal
from pageloom.functions.urls import normalize_url, normalized_host
from pageloom.operators.frontier import fetch_outcome, frontier_step, seed_level
from pageloom.operators.links import allowed_hosts, captures, extract_links, host_list
from pageloom.operators.ranking import first_per_group, first_ranks
from pageloom.plans.config import CrawlConfig
from pageloom.session import KeyedLog, bucket_count, cut_lineage, shuffle_partitions, store_by

ORDER = ["depth", "path"]


def crawl(
    pages: DataFrame, seeds: DataFrame, config: CrawlConfig, allowed: DataFrame | None = None
) -> DataFrame:
    """All visited URLs: ``(site, url, depth, path, via, page_id, fetched)``.

    ``seeds(site, start_url)`` starts one crawl per site, each with its own
    visited set and page limit.  ``allowed(domain)`` is an allowlist of any size
    and replaces ``config.allowed_domains``.  A site's crawl ends with the page
    that fills its limit: what would come after it, in order of depth and
    discovery, is not visited.
    """
    first = cut_lineage(seed_level(seeds))
    usable = _reachable(pages.where("html IS NOT NULL"), first, config, allowed)
    one_site = first.limit(2).count() == 1
    buckets = bucket_count(pages)
    captured = _stored(captures(usable), one_site, buckets)
    edges = _stored(_edges(usable, captured, config, allowed), one_site, buckets)
    if one_site:
        return _crawl_one(first, edges, captured, config, buckets)

    levels: list[DataFrame] = []
    level = first
    for depth in range(config.max_depth + 1):
        outcome = cut_lineage(fetch_outcome(level, captured))
        if config.max_pages is not None:
            outcome = cut_lineage(_within_limit(outcome, levels, config.max_pages, one_site=False))
        levels.append(outcome)
        if depth == config.max_depth:
            break
        visited = reduce(DataFrame.unionByName, levels)
        level = _open_sites(outcome.where("fetched"), visited, config)
        level = cut_lineage(frontier_step(level, edges, visited))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def _crawl_one(
    first: DataFrame, edges: DataFrame, captured: DataFrame, config: CrawlConfig, buckets: int
) -> DataFrame:
    """The rounds of a single crawl over a visited set that only grows."""
    spark = first.sparkSession
    visited = KeyedLog(spark, "url", buckets)
    with shuffle_partitions(spark, buckets):
        for depth in range(config.max_depth + 1):
            if depth:
                earlier = visited.rows()
                level = _open_sites(earlier.where(f"depth = {depth - 1} AND fetched"), earlier, config)
                outcome = visit_step(level, edges, earlier, captured)
            else:
                earlier, outcome = None, fetch_outcome(first, captured)
            if config.max_pages is not None:
                outcome = cut_lineage(outcome)
                held = [] if earlier is None else [earlier]
                outcome = _within_limit(outcome, held, config.max_pages, one_site=True).repartition(buckets, "url")
            visited.append(outcome)
            if depth < config.max_depth and visited.rows().where(f"depth = {depth}").isEmpty():
                break
    return visited.close()


def visit_step(level: DataFrame, edges: DataFrame, visited: DataFrame, captured: DataFrame) -> DataFrame:
    """Targets of a level's links that were not visited before, with their outcome; of one crawl.

    ``edges``, ``visited`` and ``captured`` are bucketed by URL, so the one
    exchange is that of the targets, reduced on the map side first.
    """
    found = level.join(edges.select("url", "pos", "link"), "url").selectExpr(
        "site", "link", "depth + 1 AS depth", "struct(concat(path, array(pos)) AS path, url AS via) AS first"
    )
    unique = found.groupBy(F.col("link").alias("url")).agg(
        F.min("site").alias("site"), F.min("depth").alias("depth"), F.min("first").alias("first")
    )
    fresh = unique.join(visited.select("url"), "url", "left_anti")
    return fetch_outcome(fresh.select("site", "url", "depth", "first.path", "first.via"), captured).select(
        "site", "url", "depth", "path", "via", "page_id", "fetched"
    )


def _stored(by_url: DataFrame, one_site: bool, buckets: int) -> DataFrame:
    """Store links or captures for the rounds.

    In a single crawl every URL occurs once per level, so bucketing by URL is
    safe and saves the shuffle in each round.  When many crawls run together,
    one URL may be in most of them; then both sides of the join are shuffled, so
    that the adaptive skew join can split it.
    """
    if not one_site:
        return cut_lineage(by_url)
    return store_by(by_url.repartition(buckets, "url"), "url", buckets)


def _reachable(
    pages: DataFrame, first: DataFrame, config: CrawlConfig, allowed: DataFrame | None
) -> DataFrame:
    """Pages a crawl can reach at all, so links of other hosts are never extracted.

    Without an allowlist links stay on their host, so only the hosts of the
    seeds matter.  The start page itself is exempt from the allowlist.
    """
    if allowed is not None:
        return pages
    hosted = pages.withColumn("_url", F.expr(normalize_url("url"))).withColumn(
        "_host", F.expr(normalized_host("_url"))
    )
    starts = first.select(F.col("url").alias("_url")).distinct()
    if config.allowed_domains:
        hosts = allowed_hosts(pages, config.allowed_domains, lower=config.lower_allowlist)
        listed = host_list(hosts)
        if listed is None:
            within, outside = (hosted.join(hosts, hosted["_host"] == hosts["host"], how) for how in ("left_semi", "left_anti"))
        else:
            within, outside = hosted.where(f"_host IN ({listed})"), hosted.where(f"_host NOT IN ({listed})")
        kept = within.unionByName(outside.join(starts, "_url", "left_semi"))
    else:
        hosts = starts.selectExpr(f"{normalized_host('_url')} AS _host").distinct()
        kept = hosted.join(hosts, "_host", "left_semi")
    return kept.select(pages.columns)


def _edges(
    pages: DataFrame, captured: DataFrame, config: CrawlConfig, allowed: DataFrame | None
) -> DataFrame:
    """Followable links ``(url, pos, link)`` of the captured pages, each page once."""
    rule = allowed if allowed is not None else (config.allowed_domains or None)
    links = extract_links(pages, rule, lower_allowlist=config.lower_allowlist)
    return links.join(captured.select("page_id"), "page_id", "left_semi").select(
        "url", "pos", "link"
    )


def _within_limit(level: DataFrame, earlier: list[DataFrame], max_pages: int, one_site: bool) -> DataFrame:
    """Rows of a level up to the page that fills its site's limit."""
    ranked = first_ranks(level.where("fetched").select("site", "path"), ["site"], ["path"], max_pages, "_rank")
    if earlier:
        fetched = reduce(DataFrame.unionByName, earlier).where("fetched")
        ranked = ranked.join(fetched.groupBy("site").agg(F.count("*").alias("_before")), "site", "left")
    else:
        ranked = ranked.withColumn("_before", F.lit(0))
    filled = F.col("_rank") + F.coalesce("_before", F.lit(0)) == max_pages
    last = ranked.where(filled).select("site", F.col("path").alias("_last"))
    # At most one row per site; of a single crawl, at most one at all.
    joined = level.join(F.broadcast(last) if one_site else last, "site", "left")
    return joined.where("_last IS NULL OR path <= _last").select(level.columns)


def _open_sites(level: DataFrame, visited: DataFrame, config: CrawlConfig) -> DataFrame:
    """Drop sites that already have ``max_pages`` results: they need no further level."""
    if config.max_pages is None:
        return level
    counts = visited.where("fetched").groupBy("site").count()
    full = counts.where(F.col("count") >= config.max_pages).select("site")
    return level.join(full, "site", "left_anti")


def crawl_results(visited: DataFrame, config: CrawlConfig) -> DataFrame:
    """Result pages ``(site, url, depth, path, page_id)``, at most ``max_pages`` per site.

    Only fetched pages count towards the limit; first come the shallow ones, in
    order of discovery.
    """
    found = visited.where("fetched").select("site", "url", *ORDER, "page_id")
    if config.max_pages is None:
        return found
    return first_per_group(found, ["site"], ORDER, config.max_pages)


def crawl_site(pages: DataFrame, start_url: str, config: CrawlConfig) -> DataFrame:
    """One crawl from one start URL; a malformed start URL is an error."""
    spark = pages.sparkSession
    seeds = spark.range(1).selectExpr("id AS site", f"{literal(start_url)} AS start_url")
    if seed_level(seeds).isEmpty():
        raise ValueError(f"not an absolute http(s) URL: {start_url!r}")
    return crawl(pages, seeds, config)


def level_stats(visited: DataFrame) -> DataFrame:
    """``(depth, n_urls, n_fetched)``."""
    return visited.groupBy("depth").agg(
        F.count("*").alias("n_urls"), F.count_if("fetched").alias("n_fetched")
    )


def links_added(visited: DataFrame) -> DataFrame:
    """``(site, url, n_added)``: new URLs each page brought into the frontier."""
    return (
        visited.where("via IS NOT NULL")
        .groupBy("site", F.col("via").alias("url"))
        .agg(F.count("*").alias("n_added"))
    )


def crawl_totals(visited: DataFrame) -> DataFrame:
    """One row ``(n_visited, n_results, max_depth)``."""
    return visited.agg(
        F.count("*").alias("n_visited"),
        F.count_if("fetched").alias("n_results"),
        F.max("depth").alias("max_depth"),
    )


def incremental_frontier(level: DataFrame, live_keys: DataFrame) -> DataFrame:
    """Frontier rows whose URL has no live stored result: what still has to be crawled.

    ``live_keys(key)`` must hold each key once.
    """
    return level.join(live_keys.select(F.col("key").alias("url")), "url", "left_anti").select(
        level.columns
    )


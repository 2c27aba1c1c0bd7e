"""Queries on the crawl closure, its results, plans and bookkeeping tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.urls import normalize_url, url_host
from pageloom.operators import store
from pageloom.operators.frontier import fetch_outcome, frontier_step, seed_level, visited_flag
from pageloom.operators.links import captures, extract_links
from pageloom.plans.config import CrawlConfig
from pageloom.plans.convert import result_pages
from pageloom.plans.crawl import (
    crawl,
    crawl_results,
    crawl_totals,
    incremental_frontier,
    level_stats,
    links_added,
)
from pageloom.plans.fetch import fetch_schedule
from pageloom.plans.refresh import refresh
from pageloom.plans.retry import is_retryable, retry_plan
from pageloom.session import new_folder
from pageloom.sinks.documents import export_layout
from pageloom.sinks.report import report_lines, summary_lines
from pageloom.sources.pages import stream_pages as page_stream
from pageloom.streaming.flows import append_stream, convert_stream, store_stream, visited_stream
from pageloom.workload.content_queries import ORACLES as CONTENT_ORACLES
from pageloom.workload.oracles import ARTICLE, CRAWL, LINKS, bfs, host, norm
from pageloom.workload.tables import attempts, linked_pages, pages, results, table

DEPTH, MAX_PAGES, LARGE_LIMIT = 4, 60, 120
AS_OF = "2024-01-20 00:00:00"


def _as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def _start(source):
    return source.where("page_id = 0").selectExpr("0 AS site", "url AS start_url")


def _hosts(source):
    return source.selectExpr(f"{url_host('url')} AS domain").distinct()


def _visited(spark, sf_dir, max_pages=None, depth=DEPTH):
    source = linked_pages(spark, sf_dir)
    config = CrawlConfig(max_depth=depth, max_pages=max_pages)
    return crawl(source, _start(source), config, _hosts(source)), config


def crawl_bfs(spark, sf_dir):
    return _visited(spark, sf_dir)[0].select("url", "depth", "fetched")


def crawl_max_pages(spark, sf_dir):
    found = crawl_results(*_visited(spark, sf_dir, MAX_PAGES))
    return found.selectExpr("url", "depth", "array_join(path, '.') AS path")


def crawl_domain(spark, sf_dir):
    """One crawl per host, from its first page, staying on the host."""
    source = linked_pages(spark, sf_dir)
    hosts = source.selectExpr("page_id", "url", f"{url_host('url')} AS host")
    seeds = hosts.groupBy("host").agg(F.min_by("url", "page_id").alias("start_url"))
    seeds = seeds.select(F.col("host").alias("site"), "start_url")
    visited = crawl(source, seeds, CrawlConfig(max_depth=2, max_pages=None))
    return visited.select("site", "url", "depth", "fetched")


def crawl_level_stats(spark, sf_dir):
    return level_stats(_visited(spark, sf_dir)[0])


def crawl_links_added(spark, sf_dir):
    return links_added(_visited(spark, sf_dir)[0]).select("url", "n_added")


def crawl_summary(spark, sf_dir):
    return crawl_totals(_visited(spark, sf_dir)[0])


def crawl_level_stats_limited(spark, sf_dir):
    return level_stats(_visited(spark, sf_dir, MAX_PAGES)[0])


def crawl_summary_limited(spark, sf_dir):
    """Totals of a crawl that its page limit ends; the limit is one that needs exact ranks."""
    return crawl_totals(_visited(spark, sf_dir, LARGE_LIMIT)[0])


def crawl_summary_lines(spark, sf_dir):
    return summary_lines(crawl_results(*_visited(spark, sf_dir))).select("number", "line")


def crawl_results_query(spark, sf_dir):
    found = crawl_results(*_visited(spark, sf_dir))
    return result_pages(linked_pages(spark, sf_dir), found).select("url", "markdown", "depth")


def crawl_report(spark, sf_dir):
    """The JSON report of a whole crawl, one row per line group."""
    found = crawl_results(*_visited(spark, sf_dir))
    rows = result_pages(linked_pages(spark, sf_dir), found)
    return report_lines(rows, "https://start.example/").select("section", "text")


def export_layout_query(spark, sf_dir):
    return export_layout(pages(spark, sf_dir), "out/site.MD")


def fetch_outcome_query(spark, sf_dir):
    """Captures against a frontier of every page URL and every link of it."""
    source = pages(spark, sf_dir)
    own = source.selectExpr(f"{normalize_url('url')} AS url")
    level = own.unionByName(extract_links(source).selectExpr("link AS url")).distinct()
    return fetch_outcome(level, captures(source)).select("url", "page_id", "fetched")


def frontier_step_query(spark, sf_dir):
    """One step from all pages at once, with the pages themselves as visited."""
    source = linked_pages(spark, sf_dir)
    edges = extract_links(source, _hosts(source))
    level = seed_level(source.selectExpr("0 AS site", "url AS start_url"))
    odd = level.where("length(url) % 2 = 1")
    step = frontier_step(level, edges, odd)
    return step.selectExpr("url", "depth", "array_join(path, '.') AS path")


def visited_flag_query(spark, sf_dir):
    source = pages(spark, sf_dir)
    visited = source.where("startswith(url, 'https:')").selectExpr(f"{normalize_url('url')} AS url")
    return visited_flag(source.select("page_id", "url"), visited.distinct()).select(
        "page_id", "norm_url", "is_visited"
    )


def incremental_frontier_query(spark, sf_dir):
    """Pages whose stored result (written when the user of that number was last seen) is gone."""
    level = pages(spark, sf_dir).selectExpr("page_id", f"{normalize_url('url')} AS url", "0 AS depth")
    seen = table(spark, sf_dir, "events").selectExpr("user_id AS page_id", "ts")
    written = level.join(seen, "page_id").selectExpr("url AS key", "'x' AS value", "ts")
    kept = store.live(store.entries(written, F.col("ts"), ttl_hours=36), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))
    return incremental_frontier(level.select("url", "depth").distinct(), kept)


def crawl_twice(spark, sf_dir):
    """Two runs against one store: shallow pages are stored half a day before the others, and the second run
    comes when only they have expired.
    """
    source = linked_pages(spark, sf_dir)
    visited, config = _visited(spark, sf_dir)
    found = crawl_results(visited, config)

    def at(hours):
        return F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '{hours}' HOUR")

    path = new_folder(spark, "store")
    held = store.clear(store.entries(found.selectExpr("url AS key", "'' AS value"), at(0)))
    for part, hours in (("depth <= 1", 0), ("depth > 1", 12), ("true", 30)):
        store.append(refresh(source, found.where(part), held, at(hours)), path)
        held = spark.read.parquet(path)
    again = spark.read.parquet(path)
    written = again.groupBy("key").agg(F.count("*").alias("n_writes"))
    return store.live(again, at(30)).join(written, "key").selectExpr(
        "key AS url", "written_at", "expires_at", "n_writes", "length(value) > 0 AS filled"
    )


def _store(spark, sf_dir):
    return store.entries(results(spark, sf_dir), F.col("ts"))


def store_put(spark, sf_dir):
    return store.newest(_store(spark, sf_dir))


def store_get(spark, sf_dir):
    """Lookups by every customer number, as of the middle of the month."""
    keys = table(spark, sf_dir, "customer").selectExpr("concat('u', c_custkey) AS key")
    month = _store(spark, sf_dir).where(F.col("written_at") <= _as_of())
    return store.lookup(keys, month, _as_of())


def store_delete(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    left = store.delete(_store(spark, sf_dir), keys.selectExpr("concat('u', c_custkey) AS key"))
    return left.groupBy("key").agg(F.count("*").alias("n_writes"))


def store_count(spark, sf_dir):
    month = _store(spark, sf_dir).where(F.col("written_at") <= _as_of())
    return store.item_count(month, _as_of())


def retry_classify(spark, sf_dir):
    return attempts(spark, sf_dir).select(
        "seq", "error", is_retryable(F.col("error")).alias("retryable")
    )


def retry_schedule(spark, sf_dir):
    return retry_plan(attempts(spark, sf_dir))


def fetch_schedule_query(spark, sf_dir):
    urls = pages(spark, sf_dir).selectExpr("page_id", f"{url_host('url')} AS host")
    return fetch_schedule(urls, ["page_id"], 2.5, 500)


def stream_pages(spark, sf_dir):
    """The page table as a stream of files, converted batch by batch."""
    out = new_folder(spark, "stream-pages")
    stream = page_stream(spark, f"{sf_dir}/pages.parquet*")
    convert_stream(stream, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("page_id", "url", "markdown")


def stream_visited(spark, sf_dir):
    """Distinct URLs in a flow of page views, one URL per user."""
    out = new_folder(spark, "stream-visited")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    views = events.selectExpr(
        "cast(ts AS timestamp) AS ts", "concat('HTTPS://Users.example/', user_id, '/#', event_id) AS url"
    )
    append_stream(visited_stream(views), out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("url")


def stream_store(spark, sf_dir):
    """The store fed by a stream of results; the newest write of each key."""
    out = new_folder(spark, "stream-store")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    rows = events.selectExpr("concat('u', user_id) AS key", "event_type AS value", "ts")
    store_stream(store.entries(rows, F.col("ts")), out, f"{out}-state").awaitTermination()
    return store.newest(spark.read.parquet(out).select(store.STORE_COLUMNS))


QUERIES = {
    "fetch_outcome": fetch_outcome_query,
    "frontier_step": frontier_step_query,
    "visited_flag": visited_flag_query,
    "crawl_bfs": crawl_bfs,
    "crawl_max_pages": crawl_max_pages,
    "crawl_domain": crawl_domain,
    "crawl_level_stats": crawl_level_stats,
    "crawl_links_added": crawl_links_added,
    "crawl_summary": crawl_summary,
    "crawl_level_stats_limited": crawl_level_stats_limited,
    "crawl_summary_limited": crawl_summary_limited,
    "crawl_summary_lines": crawl_summary_lines,
    "crawl_results": crawl_results_query,
    "crawl_report": crawl_report,
    "export_layout": export_layout_query,
    "incremental_frontier": incremental_frontier_query,
    "crawl_twice": crawl_twice,
    "store_put": store_put,
    "store_get": store_get,
    "store_delete": store_delete,
    "store_count": store_count,
    "retry_classify": retry_classify,
    "retry_schedule": retry_schedule,
    "fetch_schedule": fetch_schedule_query,
    "stream_pages": stream_pages,
    "stream_visited": stream_visited,
    "stream_store": stream_store,
}


def _json(value: str) -> str:
    out = f"CAST(to_json({value}) AS VARCHAR)"
    for char, code in (("'<'", "003c"), ("'>'", "003e"), ("'&'", "0026"), ("chr(8232)", "2028"), ("chr(8233)", "2029")):
        out = f"replace({out}, {char}, '\\u{code}')"
    return out


_TEXT_PATH = "array_to_string(path, '.')"
_ENTRIES = """ent AS (SELECT 'u' || user_id AS key, event_type AS value, ts AS written_at,
    ts + INTERVAL 24 HOUR AS expires_at FROM events)"""
_NEWEST = """lst AS (SELECT key, max(struct_pack(w := written_at, v := value, e := expires_at)) AS l
    FROM ent {0} GROUP BY key)"""
_UNTIL = f"WHERE written_at <= TIMESTAMP '{AS_OF}'"
_ERROR = """CASE event_type WHEN 'error' THEN 'i/o Timeout' WHEN 'view' THEN 'Connection reset'
    WHEN 'click' THEN 'Temporarily unavailable' WHEN 'signup' THEN 'HTTP 404 not found' END"""
_NUMBERED = f"""{bfs(DEPTH)},
num AS (SELECT b.*, c.page_id, row_number() OVER (ORDER BY depth, path) AS number
        FROM best b JOIN cap c USING (url))"""


def _limited(limit: int) -> str:
    """``seen``: URLs visited until the page that fills the limit, in order of depth and path."""
    return f"""{bfs(DEPTH)},
got AS (SELECT b.depth, b.path, row_number() OVER (ORDER BY b.depth, b.path) AS n FROM best b JOIN cap USING (url)),
seen AS (SELECT b.depth, b.url IN (SELECT url FROM cap) AS fetched FROM best b
         WHERE NOT EXISTS (SELECT 1 FROM got WHERE n = {limit}
               AND (b.depth > got.depth OR b.depth = got.depth AND b.path > got.path)))"""


ORACLES = {
    "fetch_outcome": f"""
        WITH {LINKS}, cap AS (SELECT url, min(page_id) AS page_id FROM pg GROUP BY url),
             lev AS (SELECT url FROM pg UNION SELECT link FROM lk)
        SELECT url, page_id, page_id IS NOT NULL AS fetched FROM lev LEFT JOIN cap USING (url)""",
    "frontier_step": f"""
        WITH {CRAWL} SELECT link AS url, CAST(1 AS INTEGER) AS depth, CAST(min(pos) AS VARCHAR) AS path
        FROM (SELECT link, p.pos FROM (
                SELECT url, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INTEGER) AS pos
                FROM every JOIN pg USING (page_id)) p)
        WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.url = link AND length(pg.url) % 2 = 1)
        GROUP BY link""",
    "visited_flag": f"""
        SELECT page_id, {norm('url')} AS norm_url,
               {norm('url')} IN (SELECT {norm('url')} FROM pages WHERE url LIKE 'https:%') AS is_visited
        FROM pages""",
    "crawl_bfs": f"""
        WITH RECURSIVE {bfs(DEPTH)} SELECT url, depth, url IN (SELECT url FROM cap) AS fetched FROM least""",
    "crawl_max_pages": f"""
        WITH RECURSIVE {bfs(DEPTH)} SELECT url, depth, {_TEXT_PATH} AS path FROM best JOIN cap USING (url)
        ORDER BY depth, best.path LIMIT {MAX_PAGES}""",
    "crawl_domain": f"""
        WITH RECURSIVE {CRAWL},
        walk AS (SELECT {host('url')} AS site, arg_min(url, page_id) AS url, 0 AS depth FROM cap GROUP BY 1
                 UNION SELECT w.site, e.link, w.depth + 1 FROM walk w JOIN edges e USING (url)
                 WHERE w.depth < 2 AND {host('e.link')} = w.site)
        SELECT site, url, min(depth) AS depth, url IN (SELECT url FROM cap) AS fetched
        FROM walk GROUP BY site, url""",
    "crawl_level_stats": f"""
        WITH RECURSIVE {bfs(DEPTH)}
        SELECT depth, count(*) AS n_urls, count(cap.url) AS n_fetched
        FROM least LEFT JOIN cap USING (url) GROUP BY depth""",
    "crawl_links_added": f"""
        WITH RECURSIVE {bfs(DEPTH)}
        SELECT p.url, count(*) AS n_added FROM best c JOIN best p
        ON p.depth = c.depth - 1 AND p.path = c.path[:-2] GROUP BY p.url""",
    "crawl_summary": f"""
        WITH RECURSIVE {bfs(DEPTH)}
        SELECT count(*) AS n_visited, count(cap.url) AS n_results, max(depth) AS max_depth
        FROM least LEFT JOIN cap USING (url)""",
    "crawl_level_stats_limited": f"""
        WITH RECURSIVE {_limited(MAX_PAGES)}
        SELECT depth, count(*) AS n_urls, count(*) FILTER (fetched) AS n_fetched FROM seen GROUP BY depth""",
    "crawl_summary_limited": f"""
        WITH RECURSIVE {_limited(LARGE_LIMIT)}
        SELECT count(*) AS n_visited, count(*) FILTER (fetched) AS n_results, max(depth) AS max_depth FROM seen""",
    "crawl_summary_lines": f"""
        WITH RECURSIVE {_NUMBERED}
        SELECT number, '[' || number || '] ' || url || ' (depth: ' || depth || ')' AS line FROM num""",
    "crawl_results": f"""
        WITH RECURSIVE {bfs(DEPTH)}, {ARTICLE}
        SELECT least.url, markdown, depth FROM least JOIN cap USING (url) JOIN mdd USING (page_id)""",
    "crawl_report": f"""
        WITH RECURSIVE {bfs(DEPTH)}, {ARTICLE},
        num AS (SELECT b.url, depth, markdown, row_number() OVER (ORDER BY depth DESC, path DESC) AS back
                FROM best b JOIN cap c USING (url) JOIN mdd USING (page_id))
        SELECT 0 AS section, '{{' || chr(10) || '  "pages": [' AS text
        UNION ALL SELECT 1, '    {{' || chr(10) || '      "url": ' || {_json('url')} || ',' || chr(10)
          || '      "markdown": ' || {_json('markdown')} || ',' || chr(10) || '      "depth": ' || depth
          || chr(10) || '    }}' || CASE WHEN back = 1 THEN '' ELSE ',' END FROM num
        UNION ALL SELECT 2, '  ],' || chr(10) || '  "total": ' || count(*) || ',' || chr(10)
          || '  "url": "https://start.example/"' || chr(10) || '}}' FROM num""",
    "export_layout": """
        SELECT count(*) AS total, CASE WHEN count(*) = 1 THEN 'file' ELSE 'directory' END AS mode,
               CASE WHEN count(*) = 1 THEN 'out/site.MD' ELSE 'out/site' END AS target FROM pages""",
    "incremental_frontier": f"""
        WITH p AS (SELECT page_id, {norm('url')} AS url FROM pages),
             w AS (SELECT url, max(ts) AS ts FROM p JOIN events ON user_id = page_id GROUP BY url)
        SELECT DISTINCT url, 0 AS depth FROM p
        WHERE url NOT IN (SELECT url FROM w WHERE ts + INTERVAL 36 HOUR > TIMESTAMP '2024-01-31 00:00:00')""",
    "crawl_twice": f"""
        WITH RECURSIVE {bfs(DEPTH)}, f AS (SELECT url, depth FROM least JOIN cap USING (url))
        SELECT url, TIMESTAMP '2024-01-01' + to_hours(CASE WHEN depth <= 1 THEN 30 ELSE 12 END) AS written_at,
               TIMESTAMP '2024-01-02' + to_hours(CASE WHEN depth <= 1 THEN 30 ELSE 12 END) AS expires_at,
               CASE WHEN depth <= 1 THEN 2 ELSE 1 END::BIGINT AS n_writes, true AS filled FROM f""",
    "store_put": f"""
        WITH {_ENTRIES}, {_NEWEST.format('')}
        SELECT key, l.v AS value, l.w AS written_at, l.e AS expires_at FROM lst""",
    "store_get": f"""
        WITH {_ENTRIES}, {_NEWEST.format(_UNTIL)},
             hit AS (SELECT key, l.v AS value FROM lst WHERE l.e > TIMESTAMP '{AS_OF}')
        SELECT k.key, value, hit.key IS NOT NULL AS found
        FROM (SELECT 'u' || c_custkey AS key FROM customer) k LEFT JOIN hit USING (key)""",
    "store_delete": f"""
        WITH {_ENTRIES} SELECT key, count(*) AS n_writes FROM ent WHERE key NOT IN
          (SELECT 'u' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY key""",
    "store_count": f"""
        WITH {_ENTRIES}, {_NEWEST.format(_UNTIL)}
        SELECT count(*) FILTER (l.e > TIMESTAMP '{AS_OF}') AS n_items,
               count(*) FILTER (NOT l.e > TIMESTAMP '{AS_OF}') AS n_expired FROM lst""",
    "retry_classify": f"""
        SELECT event_id AS seq, {_ERROR} AS error, event_type IN ('error', 'view', 'click') AS retryable
        FROM events""",
    "retry_schedule": f"""
        WITH a AS (SELECT 'u' || user_id AS key, ts, {_ERROR} AS error,
                          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
             s AS (SELECT *, CASE WHEN error IS NULL THEN 'done' WHEN error LIKE 'HTTP%' THEN 'fatal'
                             WHEN n = 4 THEN 'exhausted' ELSE 'retry' END AS status FROM a WHERE n <= 4)
        SELECT key, CAST(n AS INTEGER) AS attempt, ts, status, CASE WHEN status = 'retry'
               THEN ts + to_seconds(CAST(least(pow(2, n - 1), 10) AS INTEGER)) END AS retry_at
        FROM s WHERE NOT EXISTS (SELECT 1 FROM s e WHERE e.key = s.key AND e.n < s.n AND e.status != 'retry')""",
    "fetch_schedule": f"""
        WITH r AS (SELECT page_id, {host('url')} AS host,
                          row_number() OVER (PARTITION BY {host('url')} ORDER BY page_id) AS rank FROM pages)
        SELECT page_id, host, rank, greatest(0, (rank - 2) / 2.5::DOUBLE) + 0.5::DOUBLE AS start_seconds FROM r""",
    "stream_pages": CONTENT_ORACLES["md_document"],
    "stream_visited": "SELECT DISTINCT 'https://users.example/' || user_id AS url FROM events",
}
ORACLES["stream_store"] = ORACLES["store_put"]

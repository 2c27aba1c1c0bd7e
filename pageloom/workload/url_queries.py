"""Queries on URLs and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.urls import (
    is_valid_url,
    normalize_url,
    resolve_url,
    same_domain,
    url_filename,
    url_host,
)
from pageloom.operators.links import (
    extract_links,
    link_degrees,
    link_graph,
    normalize_allowlist,
    raw_links,
)
from pageloom.sinks.documents import document_files
from pageloom.workload.oracles import LINKS, encode, host, norm
from pageloom.workload.tables import pages


def page_source(spark, sf_dir):
    return pages(spark, sf_dir).selectExpr("page_id", "url", "octet_length(html) AS html_bytes")


def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).selectExpr("page_id", "url", f"{normalize_url('url')} AS norm_url")


def url_resolve(spark, sf_dir):
    """Every page URL against a relative reference made from its id."""
    ref = "concat('../x', page_id, '/./y é?q=', page_id, '#f')"
    return pages(spark, sf_dir).selectExpr("page_id", f"{resolve_url('url', ref)} AS abs_url")


def url_valid(spark, sf_dir):
    """Page URLs, and the same with another scheme or none."""
    forms = "explode(array(url, regexp_replace(url, '^https?', 'ftp'), regexp_replace(url, '^https?://', '')))"
    urls = pages(spark, sf_dir).selectExpr("page_id", f"{forms} AS url")
    return urls.selectExpr("page_id", "url", f"{is_valid_url('url')} AS valid")


def url_same_domain(spark, sf_dir):
    """Each page URL against the next one, and against itself with a port."""
    source = pages(spark, sf_dir)
    following = source.selectExpr("page_id - 1 AS page_id", "url AS other")
    return source.join(following, "page_id").selectExpr(
        "page_id",
        f"{same_domain('url', 'other')} AS same_next",
        f"{same_domain('url', 'regexp_replace(url, ' + chr(39) + '^(https?://[^/]*)' + chr(39) + ', ' + chr(39) + '$1:8080' + chr(39) + ')')} AS same_port",
    )


def url_host_query(spark, sf_dir):
    return pages(spark, sf_dir).selectExpr("page_id", f"{url_host('url')} AS host")


def _domains(spark, sf_dir):
    """Allowlist entries of three kinds: bare host, upper-case host, host with scheme."""
    entry = f"""CASE page_id % 3 WHEN 0 THEN {url_host('url')} WHEN 1 THEN upper({url_host('url')})
        ELSE concat('http://', {url_host('url')}, '/x') END"""
    return pages(spark, sf_dir).selectExpr(f"{entry} AS domain").distinct()


def allowlist_norm(spark, sf_dir):
    return normalize_allowlist(_domains(spark, sf_dir))


def url_filename_query(spark, sf_dir):
    return pages(spark, sf_dir).selectExpr("page_id", f"{url_filename('url', 'page_id')} AS file")


def filename_collisions(spark, sf_dir):
    """The page that keeps each file name."""
    files = document_files(pages(spark, sf_dir).drop("html"), ["page_id"], "page_id")
    return files.select("file", "page_id")


def links_raw(spark, sf_dir):
    return raw_links(pages(spark, sf_dir)).select("page_id", "pos", "href", "abs_url")


def links_extract(spark, sf_dir):
    return extract_links(pages(spark, sf_dir))


def links_allowlist(spark, sf_dir):
    """Allowlist as a table: the hosts of pages with an https URL."""
    secure = pages(spark, sf_dir).where("startswith(url, 'https:')")
    allowed = secure.selectExpr(f"{url_host('url')} AS domain").distinct()
    return extract_links(pages(spark, sf_dir), allowed)


def links_same_host(spark, sf_dir):
    links = extract_links(pages(spark, sf_dir))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("link").alias("first_link"))


def link_graph_query(spark, sf_dir):
    source = pages(spark, sf_dir)
    return link_graph(extract_links(source), source)


def link_degrees_query(spark, sf_dir):
    return link_degrees(extract_links(pages(spark, sf_dir)))


QUERIES = {
    "page_source": page_source,
    "url_normalize": url_normalize,
    "url_resolve": url_resolve,
    "url_valid": url_valid,
    "url_same_domain": url_same_domain,
    "url_host": url_host_query,
    "allowlist_norm": allowlist_norm,
    "url_filename": url_filename_query,
    "filename_collisions": filename_collisions,
    "links_raw": links_raw,
    "links_extract": links_extract,
    "links_allowlist": links_allowlist,
    "links_same_host": links_same_host,
    "link_graph": link_graph_query,
    "link_degrees": link_degrees_query,
}

_PATH = "regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)"
FILE = f"""replace({host('url')}, '.', '_') || '_'
    || replace(regexp_replace(regexp_replace({_PATH}, '^/', ''), '/$', ''), '/', '_') || '.md'"""

ORACLES = {
    "page_source": "SELECT page_id, url, CAST(strlen(html) AS INTEGER) AS html_bytes FROM pages",
    "url_normalize": f"SELECT page_id, url, {norm('url')} AS norm_url FROM pages",
    "url_resolve": f"""
        WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*') AS site, {_PATH} AS path FROM pages),
             d AS (SELECT page_id, site, regexp_replace(path, '/[^/]*$', '') AS folder FROM p)
        SELECT page_id, site || regexp_replace(folder, '/[^/]*$', '') || '/x' || page_id || '/'
               || {encode("'y é'")} || '?q=' || page_id || '#f' AS abs_url FROM d""",
    "url_valid": """
        SELECT page_id, url, regexp_matches(url, '^https?:') AS valid FROM (
          SELECT page_id, url FROM pages
          UNION ALL SELECT page_id, regexp_replace(url, '^https?', 'ftp') FROM pages
          UNION ALL SELECT page_id, regexp_replace(url, '^https?://', '') FROM pages)""",
    "url_same_domain": f"""
        SELECT a.page_id, {host('a.url')} = {host('b.url')} AS same_next, false AS same_port
        FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""",
    "url_host": f"SELECT page_id, {host('url')} AS host FROM pages",
    "allowlist_norm": f"""
        SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN {host('url')} WHEN 1 THEN upper({host('url')})
               ELSE 'http://' || {host('url')} || '/x' END AS domain, {host('url')} AS host FROM pages""",
    "url_filename": f"SELECT page_id, {FILE} AS file FROM pages",
    "filename_collisions": f"SELECT {FILE} AS file, max(page_id) AS page_id FROM pages GROUP BY 1",
    "links_raw": f"WITH {LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, abs_url FROM raw",
    "links_extract": f"WITH {LINKS} SELECT page_id, url, CAST(pos AS INTEGER) AS pos, link FROM lk",
    "links_allowlist": f"""
        WITH {LINKS} SELECT page_id, url, CAST(pos AS INTEGER) AS pos, link FROM lk
        WHERE {host('link')} IN (SELECT {host('url')} FROM pages WHERE url LIKE 'https:%')""",
    "links_same_host": f"""
        WITH {LINKS} SELECT page_id, count(*) AS n_links, min(link) AS first_link FROM lk GROUP BY page_id""",
    "link_graph": f"""
        WITH {LINKS}, cap AS (SELECT url AS dst, min(page_id) AS dst_id FROM pg GROUP BY url)
        SELECT lk.url AS src, link AS dst, CAST(pos AS INTEGER) AS pos, page_id AS src_id, dst_id
        FROM lk LEFT JOIN cap ON cap.dst = link""",
    "link_degrees": f"""
        WITH {LINKS} SELECT url, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (
          SELECT url, 1 AS o, 0 AS i FROM lk UNION ALL SELECT link, 0, 1 FROM lk) GROUP BY url""",
}

"""Queries for single rules: list numbers and nesting, tables in a row, file names, allowlists, clearing,
store runs, written documents, arrivals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.urls import url_filename
from pageloom.operators import store
from pageloom.operators.links import extract_links
from pageloom.plans.convert import html_to_markdown, pages_to_markdown
from pageloom.plans.fetch import arrival_schedule
from pageloom.session import new_folder
from pageloom.sinks.markdown_folder import export_documents
from pageloom.workload.content_queries import ORACLES as CONTENT_ORACLES
from pageloom.workload.crawl_queries import AS_OF
from pageloom.workload.crawl_queries import ORACLES as CRAWL_ORACLES
from pageloom.workload.oracles import LINKS, host, trim
from pageloom.workload.tables import pages, results, table
from pageloom.workload.url_queries import FILE

RATE, DELAY_MS, HOSTS = 2.5, 300, 3
ALLOWED = ["https://www.therwh.example.org", "BLOG.theres.example.com", "therha.example.com/path"]


def _html(spark, sf_dir, name, key, html):
    return table(spark, sf_dir, name).selectExpr(
        f"{key} AS page_id", f"concat('https://rules.example/', {key}) AS url", f"{html} AS html"
    )


def md_ordered(spark, sf_dir):
    """The lines of every supplier as one numbered list; a supplier has some hundreds of them at any scale."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("_lines"))
    )
    items = "array_join(transform(_lines, x -> concat('<li>', x.l_orderkey, '.', x.l_linenumber, '</li>')), '')"
    source = lines.selectExpr(
        "l_suppkey AS page_id", "concat('https://rules.example/', l_suppkey) AS url",
        f"concat('<ol>', {items}, '</ol>') AS html",
    )
    return html_to_markdown(source).select("page_id", "markdown")


def md_nested_list(spark, sf_dir):
    """Every customer as a list with a list in its first item."""
    html = "concat('<ul><li>', c_name, '<ul><li>', c_mktsegment, '</li></ul></li><li>', c_custkey, '</li></ul>')"
    return html_to_markdown(_html(spark, sf_dir, "customer", "c_custkey", html)).select("page_id", "markdown")


def md_transparent(spark, sf_dir):
    """Every customer in tags that show what they hold and nothing else."""
    html = """concat('<div>', c_name, ' <span>', c_mktsegment, '</span><section><div><p>', c_custkey,
        '</p></div></section><a href="/c">go</a></div>')"""
    return html_to_markdown(_html(spark, sf_dir, "customer", "c_custkey", html)).select("page_id", "markdown")


def md_two_tables(spark, sf_dir):
    """Every order as two tables in a row: only the first gets a blank line before it."""
    html = """concat('<p>order</p><table><tr><th>key</th></tr><tr><td>', o_orderkey, '</td></tr></table>',
        '<table><tr><th>status</th></tr><tr><td>', o_orderstatus, '</td></tr></table><p>end</p>')"""
    return html_to_markdown(_html(spark, sf_dir, "orders", "o_orderkey", html)).select("page_id", "markdown")


_LETTERS = r"regexp_replace(coalesce(text, ''), '[^\\p{L}]', '')"


def url_filename_cuts(spark, sf_dir):
    """File names of URLs with long hosts, and the letters of whole texts as their path."""
    url = f"concat('https://d', doc_id, '.', repeat('x', 100 + doc_id % 90), '.example/', {_LETTERS})"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{url} AS url").selectExpr(
        "doc_id", f"{url_filename('url', 'doc_id')} AS file"
    )


def links_literal_allowlist(spark, sf_dir):
    """Links to hosts of a short list, written with and without scheme, in any case, with a path."""
    return extract_links(pages(spark, sf_dir), ALLOWED).select("page_id", "pos", "link")


def store_clear(spark, sf_dir):
    """Live and expired entries before clearing, after it, and after some were put again."""
    held = store.entries(results(spark, sf_dir), F.col("ts"))
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    cleared = store.clear(held)
    again = cleared.unionByName(held.where("value = 'click'"))
    steps = [("1 before", held), ("2 cleared", cleared), ("3 again", again)]
    counted = [store.item_count(s, as_of).select(F.lit(name).alias("step"), "n_items", "n_expired") for name, s in steps]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _runs(rows):
    """Store rows put in three runs that share keys and overlap in time."""
    spark = rows.sparkSession
    runs = store.RunStore.create(spark, new_folder(spark, "runs"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for third in range(3):
        runs.put(rows.where(f"pmod(hash(key, written_at, value), 3) = {third}"))
    return runs


def store_runs_put(spark, sf_dir):
    """The newest entry of each key after three runs."""
    return _runs(store.entries(results(spark, sf_dir), F.col("ts"))).newest()


def store_runs_get(spark, sf_dir):
    """Lookups by every customer number in a store of three runs, reopened and compacted."""
    as_of = F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")
    rows = store.entries(results(spark, sf_dir), F.col("ts")).where(F.col("written_at") <= as_of)
    again = store.RunStore.open(spark, _runs(rows).path).compact(as_of, new_folder(spark, "compacted"))
    return again.get(table(spark, sf_dir, "customer").selectExpr("concat('u', c_custkey) AS key"), as_of)


def documents_written(spark, sf_dir):
    """Every page's Markdown document, written as a file of its own and read back."""
    found = pages_to_markdown(pages(spark, sf_dir)).withColumn("depth", F.expr("CAST(page_id % 3 AS INT)"))
    folder = export_documents(found, new_folder(spark, "documents"), ["page_id"], "page_id")
    return spark.read.text(folder, wholetext=True).selectExpr("_metadata.file_name AS file", "value AS document")


def arrivals(spark, sf_dir):
    """Events read as requests to a few hosts, so that one host holds a third of them."""
    requests = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"concat('h', user_id % {HOSTS}) AS host", "ts AS arrived_at"
    )
    # A day in two minutes: requests come faster than the bucket fills.
    squeezed = "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', arrived_at) div 720, TIMESTAMP_NTZ '2024-01-01 00:00:00')"
    return arrival_schedule(requests.withColumn("arrived_at", F.expr(squeezed)), ["event_id"], RATE, DELAY_MS)


QUERIES = {
    "md_ordered": md_ordered,
    "md_nested_list": md_nested_list,
    "md_transparent": md_transparent,
    "md_two_tables": md_two_tables,
    "url_filename_cuts": url_filename_cuts,
    "links_literal_allowlist": links_literal_allowlist,
    "store_clear": store_clear,
    "fetch_arrivals": arrivals,
    "store_runs_put": store_runs_put,
    "store_runs_get": store_runs_get,
    "documents_written": documents_written,
}

_COUNTED = """
    SELECT '{0}' AS step, count(*) FILTER (e > TIMESTAMP '2024-01-20 00:00:00') AS n_items,
           count(*) FILTER (NOT e > TIMESTAMP '2024-01-20 00:00:00') AS n_expired
    FROM (SELECT user_id, max(ts) + INTERVAL 24 HOUR AS e FROM events WHERE {1} GROUP BY user_id)"""
_HEAD = "list_max(list_filter(range(0, {1} + 1), lambda n: strlen({0}[1:n]) <= {1}))"
_STEP = round(1_000_000 / RATE)
_SPARE = (int(RATE) - 1) * _STEP

ORACLES = {
    "md_ordered": f"""
        WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey
                          ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem),
             t AS (SELECT l_suppkey, i, repeat(' ', CASE WHEN i < 127 THEN 2 WHEN i < 2047 THEN 3 ELSE 4 END)
                          || '1. ' || l_orderkey || '.' || l_linenumber AS line FROM n)
        SELECT l_suppkey AS page_id, {trim("string_agg(line, chr(10) ORDER BY i)")} AS markdown
        FROM t GROUP BY l_suppkey""",
    "md_nested_list": """
        SELECT c_custkey AS page_id, '- ' || c_name || ' - ' || c_mktsegment || chr(10) || '- ' || c_mktsegment
               || chr(10) || '- ' || c_custkey AS markdown FROM customer""",
    "md_transparent": """
        SELECT c_custkey AS page_id, c_name || ' ' || c_mktsegment || ' ' || c_custkey || chr(10) || '[go](/c)'
               AS markdown FROM customer""",
    "md_two_tables": """
        SELECT o_orderkey AS page_id, 'order' || repeat(chr(10), 3) || '| key |' || chr(10) || '| --- |' || chr(10)
               || '| ' || o_orderkey || ' |' || repeat(chr(10), 3) || '| status |' || chr(10) || '| --- |' || chr(10)
               || '| ' || o_orderstatus || ' |' || repeat(chr(10), 2) || 'end' AS markdown FROM orders""",
    "url_filename_cuts": f"""
        WITH p AS (SELECT doc_id, 'd' || doc_id || '_' || repeat('x', (100 + doc_id % 90)::BIGINT) || '_example' AS h,
                          regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')[1:101] AS t FROM documents),
             c AS (SELECT doc_id, h || '_' || CASE WHEN t = '' THEN 'index' ELSE t[1:{_HEAD.format('t', 100)}] END AS f FROM p)
        SELECT doc_id, f[1:{_HEAD.format('f', 200)}] || '.md' AS file FROM c""",
    "links_literal_allowlist": f"""
        WITH {LINKS}, a AS (
            SELECT page_id, pos, link FROM lk
            WHERE {host('link')} IN ('www.therwh.example.org', 'blog.theres.example.com', 'therha.example.com'))
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, link FROM a""",
    "store_clear": " UNION ALL ".join(
        _COUNTED.format(step, rows)
        for step, rows in (("1 before", "true"), ("2 cleared", "false"), ("3 again", "event_type = 'click'"))
    ),
    "fetch_arrivals": f"""
        WITH RECURSIVE r AS (
            SELECT event_id, 'h' || user_id % {HOSTS} AS host,
                   epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 720 AS came FROM events),
             n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY came, event_id) AS i FROM r),
             s AS (SELECT n.*, came - {_SPARE} AS drained FROM n WHERE i = 1
                   UNION ALL SELECT n.*, greatest(n.came - {_SPARE}, s.drained + {_STEP})
                   FROM s JOIN n ON n.host = s.host AND n.i = s.i + 1)
        SELECT event_id, host, make_timestamp(came) AS arrived_at, make_timestamp(greatest(came, drained) + {DELAY_MS * 1000}) AS start_at
        FROM s""",
    "store_runs_put": CRAWL_ORACLES["store_put"],
    "store_runs_get": CRAWL_ORACLES["store_get"],
    "documents_written": f"""
        WITH md AS ({CONTENT_ORACLES['md_document']}), named AS (SELECT page_id, {FILE} AS file FROM pages),
             won AS (SELECT file, max(page_id) AS page_id FROM named JOIN md USING (page_id) GROUP BY file)
        SELECT file, '# ' || url || repeat(chr(10), 2) || '**Source URL:** ' || url || '  ' || chr(10) || '**Depth:** '
               || page_id % 3 || '  ' || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || markdown || chr(10) AS document
        FROM won JOIN md USING (page_id)""",
}

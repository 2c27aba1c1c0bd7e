import pytest

from pageloom.operators.frontier import seed_level, visited_flag
from pageloom.plans.config import CrawlConfig
from pageloom.plans.convert import result_pages
from pageloom.plans.crawl import (
    crawl,
    crawl_results,
    crawl_site,
    crawl_totals,
    incremental_frontier,
    level_stats,
    links_added,
)

H = "https://h.example"
SITE = {
    f"{H}/": "<article>root</article><a href=/a/><a href=/b><a href=https://o.example/x><a href=/gone>",
    f"{H}/a": "<a href=/c><a href=/b#frag><a href=/>",
    f"{H}/b": "<p>bee</p><a href=/c>c</a><a href=/d>d</a>",
    f"{H}/c/": "<a href=/e>",
    f"{H}/d": None,
    f"{H}/e": "<article></article>",
    "https://o.example/x": f"<a href={H}/e>",
    "https://U.example/": "unlinked",
}


@pytest.fixture
def pages(make_pages):
    return make_pages(list(SITE.values()), list(SITE))


def seen(visited):
    return {r.url.replace(H, ""): (r.depth, r.fetched) for r in visited.collect()}


def test_breadth_first(pages):
    visited = crawl_site(pages, f"{H}/#x", CrawlConfig(max_depth=3, max_pages=None))
    assert seen(visited) == {
        "/": (0, True),
        "/a": (1, True),
        "/b": (1, True),
        "/gone": (1, False),
        "/c": (2, True),
        "/d": (2, False),
        "/e": (3, True),
    }
    order = [r.url[len(H) :] for r in visited.orderBy("depth", "path").collect()]
    assert order == ["/", "/a", "/b", "/gone", "/c", "/d", "/e"]
    assert {r.depth: (r.n_urls, r.n_fetched) for r in level_stats(visited).collect()} == {
        0: (1, 1), 1: (3, 2), 2: (2, 1), 3: (1, 1)}
    added = {r.url[len(H) :]: r.n_added for r in links_added(visited).collect()}
    assert added == {"/": 3, "/a": 1, "/b": 1, "/c": 1}
    assert tuple(crawl_totals(visited).first()) == (7, 5, 3)


def test_limits(pages):
    for depth in range(3):
        visited = crawl_site(pages, f"{H}/", CrawlConfig(max_depth=depth, max_pages=None))
        assert max(d for d, _ in seen(visited).values()) == depth
    config = CrawlConfig(max_depth=5, max_pages=3)
    visited = crawl_site(pages, f"{H}/", config)
    results = crawl_results(visited, config)
    assert sorted(r.url[len(H) :] for r in results.collect()) == ["/", "/a", "/b"]
    assert set(seen(visited)) == {"/", "/a", "/b"}  # what comes after the third page is not visited
    assert tuple(crawl_totals(visited).first()) == (3, 3, 1)
    assert {r.depth: r.n_urls for r in level_stats(visited).collect()} == {0: 1, 1: 2}
    assert {r.url[len(H) :]: r.n_added for r in links_added(visited).collect()} == {"/": 2}


def test_allowlist(pages):
    both = CrawlConfig(max_depth=2, max_pages=None, allowed_domains=("H.example", "http://o.example"))
    got = seen(crawl_site(pages, f"{H}/", both))
    assert got["https://o.example/x"] == (1, True) and got["/e"] == (2, True)
    # the start page need not be on the list, its links must
    other = CrawlConfig(max_depth=2, max_pages=None, allowed_domains=("o.example",))
    assert set(seen(crawl_site(pages, f"{H}/", other))) == {"/", "https://o.example/x"}
    exact = CrawlConfig(max_depth=2, max_pages=None, allowed_domains=("H.example",), lower_allowlist=False)
    assert set(seen(crawl_site(pages, f"{H}/", exact))) == {"/"}


def test_bad_and_missing_start(pages):
    with pytest.raises(ValueError):
        crawl_site(pages, "not-a-url", CrawlConfig())
    assert seen(crawl_site(pages, f"{H}/nowhere", CrawlConfig())) == {"/nowhere": (0, False)}


def test_many_sites_with_own_limits(spark, pages):
    seeds = spark.createDataFrame(
        [("one", f"{H}/"), ("two", f"{H}/b"), ("three", "https://u.example/"), ("bad", "x")],
        "site string, start_url string",
    )
    config = CrawlConfig(max_depth=4, max_pages=2)
    visited = crawl(pages, seeds, config)
    results = crawl_results(visited, config)
    got = {}
    for r in results.orderBy("site", "depth", "path").collect():
        got.setdefault(r.site, []).append(r.url.replace(H, ""))
    assert got == {"one": ["/", "/a"], "two": ["/b", "/c"], "three": ["https://u.example/"]}
    assert visited.count() == visited.select("site", "url").distinct().count()


def test_results_have_markdown(pages):
    config = CrawlConfig(max_depth=3, max_pages=None)
    results = crawl_results(crawl_site(pages, f"{H}/", config), config)
    rows = {r.url[len(H) :]: r.markdown for r in result_pages(pages, results).collect()}
    assert rows == {"/": "", "/a": "", "/b": "bee\n\n\n[c](/c)\n\n[d](/d)", "/c": "", "/e": ""}


def test_visited_flag_and_incremental(spark):
    urls = spark.createDataFrame([(f"{H}/a/",), (f"{H}/z",), ("bad",)], "url string")
    visited = spark.createDataFrame([(f"{H}/a",)], "url string")
    flags = {r.url: r.is_visited for r in visited_flag(urls, visited).collect()}
    assert flags == {f"{H}/a/": True, f"{H}/z": False, "bad": False}
    level = seed_level(urls.selectExpr("0 AS site", "url AS start_url"))
    live = visited.selectExpr("url AS key")
    assert [r.url for r in incremental_frontier(level, live).collect()] == [f"{H}/z"]


def test_a_round_of_one_crawl_has_one_exchange(spark):
    """Links, visited set and captures are joined where they lie; only the targets of the round's links move."""
    from pageloom.operators.frontier import fetch_outcome
    from pageloom.plans.crawl import visit_step
    from pageloom.session import KeyedLog, shuffle_partitions, store_by

    def by_url(df):
        return store_by(df.repartition(4, "url"), "url", 4)

    edges = by_url(spark.range(200).selectExpr("concat('u', id) AS url", "0 AS pos", "concat('u', 2 * id + 1) AS link"))
    captured = by_url(spark.range(200).selectExpr("concat('u', id) AS url", "id AS page_id"))
    first = spark.sql("SELECT 0 AS site, 'u0' AS url, 0 AS depth, CAST(array() AS array<int>) AS path, string(NULL) AS via")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with shuffle_partitions(spark, 4):
            log = KeyedLog(spark, "url", 4)
            log.append(fetch_outcome(first, captured))
            for depth in range(3):
                visited = log.rows()
                step = visit_step(visited.where(f"depth = {depth} AND fetched"), edges, visited, captured)
                plan = step._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange") == 1 and "SinglePartition" not in plan, plan
                log.append(step)
        found = log.close().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((r["url"], r["depth"]) for r in found) == [("u0", 0), ("u1", 1), ("u3", 2), ("u7", 3)]

from pageloom.functions.urls import normalize_url
from pageloom.operators import links as links_module
from pageloom.operators.links import (
    anchor_hrefs,
    captures,
    extract_links,
    link_degrees,
    link_graph,
    raw_links,
)
from pageloom.sources.dom import shred
from pageloom.sources.pages import read_pages

MESSY = [
    "<html><title><a href='/no'></title><!-- <a href='/no'> --><A HREF=/u1>x</A>",
    "<a class='b' href='/s?a=1&amp;b=2&copy=3'>y</a><img alt='<a href=\"/no\">'>",
    "<script>var a='<a href=\"/no\">'</script><a data-href='/no'>q</a><a href=''>e</a>",
    "<a href = \"mailto:q\">m</a><article href='/no'></article><a href='#top'>t</a>",
    "<a title=don't href=/u2>z</a><a href='/x' href='/no'>d</a><abbr href='/no'/>",
    "<a\nhref='/nl'\n>n</a><a/href=/slash>s</a><a href=/q/>u</a><a href='/cut",
    "<textarea><a href='/no'></textarea><noscript><a href='/no'></noscript><a href=/ok>",
    "<!--><a href='/after-short-comment'>x</a><!-- open <a href='/no'>",
    "<a href='/e&eacute;&#x41;&lt'>x</a></a href='/no'><a>none</a>",
    "plain < text <3 <a href='/lt'>x</a> <",
    "".join(f"<a href='/n{i}&#{i};z&#x{i:x};'>r</a>" for i in [*range(300), 0xD7FF, 0xD800, 0xFFFE, 0x1F600, 0x110000]),
]


def test_token_path_equals_tree_path(make_pages):
    pages = make_pages(MESSY)
    tokens = pages.selectExpr("page_id", f"posexplode({anchor_hrefs('html')}) AS (pos, href)")
    nodes = shred(pages, ["page_id", "node_id", "kind", "tag", "attrs"])
    tree = nodes.where("kind = 'element' AND tag = 'a' AND attrs['href'] != ''")
    by_token = [(r.page_id, r.href) for r in tokens.orderBy("page_id", "pos").collect()]
    by_tree = [(r.page_id, r.href) for r in tree.selectExpr(
        "page_id", "node_id", "attrs['href'] AS href").orderBy("page_id", "node_id").collect()]
    assert by_token == by_tree
    assert not [href for _, href in by_token if href == "/no"]


def test_token_path_equals_tree_path_on_given_pages(spark):
    pages = read_pages(spark, "/root/testdata/sf0.01/pages.parquet")
    tokens = pages.selectExpr("page_id", f"explode({anchor_hrefs('html')}) AS href")
    tree = shred(pages, ["page_id", "kind", "tag", "attrs"]).where("kind = 'element' AND tag = 'a'")
    tree = tree.selectExpr("page_id", "attrs['href'] AS href")
    assert tokens.exceptAll(tree).isEmpty() and tree.exceptAll(tokens).isEmpty()


def links_of(frame):
    return [r.link for r in frame.orderBy("page_id", "pos").collect()]


def test_rules(spark, make_pages):
    html = (
        "<nav><a href='/b#x'>1</a></nav><a href='/a'>2</a><a href='/b/'>3</a>"
        "<a href='https://Other.com/P/'>4</a><a href='ftp://h/x'>5</a><a href='http://H.example/c'>6</a>"
        "<a href='https://h.example:8/p'>7</a><a href='p2'>8</a><a href='/bad%zz'>9</a>"
    )
    pages = make_pages([html], ["https://H.example/dir/"])
    own = ["https://h.example/b", "https://h.example/a", "http://h.example/c", "https://h.example/p2"]
    assert links_of(extract_links(pages)) == own
    assert links_of(extract_links(pages, base="raw"))[-1] == "https://h.example/dir/p2"
    assert links_of(extract_links(pages, ["Other.com"])) == ["https://other.com/P"]
    assert links_of(extract_links(pages, ["Other.com"], lower_allowlist=False)) == []
    table = spark.createDataFrame([("http://other.com",), ("h.example",)], "domain string")
    assert links_of(extract_links(pages, table)) == [
        "https://h.example/b",
        "https://h.example/a",
        "https://other.com/P",
        "http://h.example/c",
        "https://h.example/p2",
    ]
    positions = [r.pos for r in extract_links(pages, table).orderBy("pos").collect()]
    assert positions == list(range(5))
    assert raw_links(pages).count() == 9


def test_both_ways_of_an_allowlist_are_equal(make_pages, monkeypatch):
    docs = ["<a href='https://a.com/1'><a href='https://b.com/2'><a href='https://a.com/3'>", "<a href='//b.com/x'>", "<a href=/y>"]
    pages = make_pages(docs)
    few = {tuple(r) for r in extract_links(pages, ["a.com", "A.com", "c.com"]).collect()}
    assert "Exchange" not in extract_links(pages, ["a.com"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(links_module, "MAX_LITERAL_ALLOWLIST", 1)
    many = {tuple(r) for r in extract_links(pages, ["a.com", "A.com", "c.com"]).collect()}
    assert few == many and {(pos, link) for _, _, pos, link in few} == {(0, "https://a.com/1"), (1, "https://a.com/3")}
    assert extract_links(pages, []).count() == 0


def test_malformed_page_url_has_no_links(make_pages):
    pages = make_pages(["<a href='https://x/'>x</a>"], ["not a url"])
    assert extract_links(pages, ["x"]).count() == 0


def test_graph_and_degrees(make_pages):
    urls = ["https://h.example/a", "https://h.example/b/", "https://h.example/b"]
    pages = make_pages(["<a href=/b>", "<a href=/a><a href=/z>", "<a href=/a>"], urls)
    links = extract_links(pages)
    graph = {(r.src_id, r.dst[-1], r.dst_id) for r in link_graph(links, pages).collect()}
    assert graph == {(0, "b", 1), (1, "a", 0), (1, "z", None), (2, "a", 0)}
    degrees = {r.url[-1]: (r.n_out, r.n_in) for r in link_degrees(links).collect()}
    assert degrees == {"a": (1, 2), "b": (3, 1), "z": (0, 1)}
    assert {r.page_id for r in captures(pages).collect()} == {0, 1}


def test_scan_reads_needed_columns_only(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    plan = pages.selectExpr(f"{normalize_url('url')} AS u")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
    links = extract_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in links

import gc

import pyarrow as pa
import pytest

from pageloom.sources import dom
from pageloom.sources.dom import page_trees, shred
from pageloom.sources.tree import VOID, TreeBuilder, decode_text, flatten

CASES = [
    ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<a href=1>x<a href=2>y</a>z", '<a href="1">x</a><a href="2">y</a>z'),
    ("<a>1<div>2<div>3</a>4</div>5</div>", "<a>1</a><div><a>2</a><div><a>3</a>4</div>5</div>"),
    (
        "<table><tr><td>a<td>b<tr><th>c</table>d",
        "<table><tbody><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></tbody></table>d",
    ),
    ("<table>x<tr><td>y</table>", "x<table><tbody><tr><td>y</td></tr></tbody></table>"),
    ("<p><b>X<br><p>Y<p>Z</p>", "<p><b>X<br></b></p><p><b>Y</b></p><p><b>Z</b></p>"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<!doctype html><p>a<table></table>b", "<p>a</p><table></table>b"),
    ("<p>a<table></table>b", "<p>a<table></table>b</p>"),
    ("a&ampb &copy &am", "a&b \xa9 &am"),
    ("<select><option>a<option>b<div>q</select>z", "<select><option>a</option><option>bq</option></select>z"),
    ("<pre>\n\nx</pre>", "<pre>\nx</pre>"),
    ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
    ("</p>x<br/></br>", "<p></p>x<br><br>"),
    ("a < b <3 <c", "a < b <3 "),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<div><script>a='<p>'</script></div>", "<div><script>a='<p>'</script></div>"),
    ("<p>a\r\nb\rc", "<p>a\nb\nc</p>"),
    ("<svg><path/>t</svg>u", "<svg><path></path>t</svg>u"),
]


def write(node):
    if node.kind == "text":
        return node.text
    if node.kind == "comment":
        return f"<!--{node.text}-->"
    inner = "".join(map(write, node.kids))
    attrs = "".join(f' {k}="{v}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")


def body(html):
    root = TreeBuilder(html).build()
    return "".join(map(write, root.kids[-1].kids))


@pytest.mark.parametrize("html,want", CASES)
def test_tree(html, want):
    assert body(html) == want


def test_head_and_attributes():
    root = TreeBuilder("<title>a&lt;b</title><body class=x id='y'><p>z").build()
    assert write(root.kids[0]) == "<head><title>a<b</title></head>"
    assert root.kids[1].attrs == {"class": "x", "id": "y"}


def test_numbering():
    rows, ends = flatten(TreeBuilder("<div><p>a</p><!--c--></div><hr>").build())
    names = [row[0].tag for row in rows]
    assert names[:5] == ["html", "head", "body", "div", "p"]
    for node, here, parent, depth, sibling, ids, tags in rows:
        assert depth == len(ids) == len(tags) and (parent == (ids[-1] if ids else -1))
        below = [r[1] for r in rows if here in r[5]]
        assert ends[here] == max(below, default=here)


def test_depth_is_bounded_and_text_kept():
    html = "<div>" * 5000 + "x" + "<p>y"
    rows, _ = flatten(TreeBuilder(html).build())
    assert max(row[3] for row in rows) <= 513
    assert "".join(r[0].text for r in rows if r[0].kind == "text") == "xy"


def test_no_reference_is_dropped():
    assert decode_text("a&#1;b&#146;&#xFDD0;&#0;&copyx &amp= &#99999999999999999999;&nope;") == (
        "a\x01b\u2019\ufdd0\ufffd\xa9x &= \ufffd&nope;"
    )


def test_page_trees_are_freed_at_once():
    html = "<p>a<b>x<p>y</b><table><tr><td>1<td>2</table><ul><li>q<li>r</ul><a href=q>s</a>"
    batch = pa.RecordBatch.from_pydict({"page_id": range(200), "url": ["u"] * 200, "html": [html] * 200})
    gc.collect()
    gc.disable()
    try:
        list(dom._tree_batches(iter([batch]), list(dom.TREE_FIELDS)))
        assert gc.collect() < 200
    finally:
        gc.enable()


def test_page_trees_hold_the_rows_of_nodes(spark, make_pages):
    pages = make_pages(["<!-- c --><p class=k>a<b>x<p>y</b ><table>z<tr><td>1<td/>2</table></P><br/>&amp;<pre>\n\nq", "", "<"])
    trees = page_trees(pages).selectExpr("page_id", "posexplode(nodes) AS (at, x)").selectExpr(
        "page_id", "x.n", "x.end", "x.parent", "x.kind", "x.tag", "x.text", "map_entries(x.attrs)", "x.up"
    )
    nodes = shred(pages).selectExpr(
        "page_id", "node_id", "end_id", "parent_id", "kind", "tag", "text", "map_entries(attrs)", "ancestors"
    )
    assert sorted(map(str, map(tuple, trees.collect()))) == sorted(map(str, map(tuple, nodes.collect())))

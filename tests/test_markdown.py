import gc
import random
import re
import time

import pyarrow as pa

from pageloom.operators.content import page_nodes, whole_body
from pageloom.operators.markdown import to_markdown
from pageloom.plans.convert import html_to_markdown, pages_to_markdown
from pageloom.sources import dom
from pageloom.sources.fold import body_markdown
from pageloom.sources.pages import PAGE_SCHEMA
from pageloom.sources.tree import TreeBuilder

CASES = [
    ("<h1>Title</h1>", "# Title"),
    ("<h6> a <i>b</i></h6>", "###### a b"),
    ("<p>This is a paragraph.</p>", "This is a paragraph."),
    ('<a href="https://example.com">Link</a>', "[Link](https://example.com)"),
    ('<img src="image.jpg" alt="Image">', "![Image](image.jpg)"),
    ("<ul><li>Item 1</li><li>Item 2</li></ul>", "- Item 1\n- Item 2"),
    ("<p>a <b>x</b> y</p>", "a **x**y"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n  1. b"),
    ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a - b\n- b"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\nb"),
    (
        "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>",
        "| h | k |\n| --- | --- |\n| 1 | 2 |",
    ),
    (
        "<p>z</p><table><tr><th>h</th></tr><tr><td>1</td></tr></table><table><tr><th>k</th></tr>"
        "<tr><th>no</th></tr><tr><td>|x|</td></tr></table><p>e</p>",
        "z\n\n\n| h |\n| --- |\n| 1 |\n\n\n| k |\n| --- |\n| |x| |\n\ne",
    ),
    ("<table><tr></tr><tr><td>1</td></tr></table>", ""),
    ('<pre><code class="language-go">x</code></pre>', "```go\nx\n```"),
    ('<pre> a\n b <code>c</code><code class="z">d</code></pre>', "```\na\n b cd\n```"),
    ('<pre><code class="hljs go">x</code></pre>', "```hljs go\nx\n```"),
    ("x<p>y</p>", "y"),
    ("<p>a</p><hr><p>b</p>", "a\n\n\n---\n\n\nb"),
    ("<blockquote><p>a</p>\n\n<p> b</p></blockquote>", "> a\n> b"),
    ("<div>a <span>b</span><p>c</p><a href=q>d</a></div>", "a b c\n[d](q)"),
    ("<p>a<em>i</em><code>k</code><strong>s</strong></p>", "a *i*`k`**s**"),
    ("<ul><li>q<blockquote>r <b>s</b><section><li>t <b>u</b></section></blockquote></li></ul>",
     "- q > r st u\n- t **u**"),
    ("", ""),
]


def converted(frame):
    return [r.markdown for r in frame.orderBy("page_id").collect()]


def test_cases(make_pages):
    got = converted(html_to_markdown(make_pages([html for html, _ in CASES])))
    assert got == [want for _, want in CASES]


def test_main_content(make_pages):
    docs = [
        "<nav>Navigation</nav><article><h1>Main Title</h1><p>main content</p></article><aside>Sidebar</aside>",
        "<article><h1>T</h1><p><b>X<br><p>Y</p><p>Z</p></article>",
        "<article><pre><code class='language-go'>x</code></pre><a href=q><img></a></article>",
        "<body class=menu>x</body>",
    ]
    assert converted(pages_to_markdown(make_pages(docs))) == [
        "# Main Title\n\n\nmain content",
        "# T\n\n\n**X**\n\n\n**Y**\n\n\n**Z**",
        "```\nx\n```\n\n\n[](q)",
        "",
    ]


def test_long_list_indents(make_pages):
    html = "<ol>" + "".join(f"<li>{i}</li>" for i in range(1, 131)) + "</ol>"
    lines = converted(html_to_markdown(make_pages([html])))[0].split("\n")
    assert lines[126] == "  1. 127" and lines[127] == "   1. 128"


def random_html(rng, depth):
    out = ""
    for _ in range(rng.randint(1, 3)):
        tag = rng.choice("p ul ol li section b a i code h2 blockquote span".split())
        inner = random_html(rng, depth - 1) if depth and rng.random() < 0.8 else ""
        out += f"<{tag}>{rng.choice(['', 'k', ' m '])}{inner}</{tag}>"
    return out


def test_random_pages_keep_the_form(make_pages):
    """What holds of every document: cut at both ends, at most two blank lines in a row, all letters known."""
    rng = random.Random(7)
    docs = [random_html(rng, rng.randint(0, 5)) for _ in range(300)]
    for html, markdown in zip(docs, converted(html_to_markdown(make_pages(docs)))):
        assert markdown == markdown.strip(), html
        assert "\n\n\n\n" not in markdown, html
        assert set(re.findall("[a-z]", markdown)) <= {"k", "m"}, html


def test_generated_tables_and_lists(make_pages):
    """Widths, counts and fences that follow from how the page was made."""
    shapes = [(rows, columns) for rows in (1, 2, 5) for columns in (1, 3)]
    docs = []
    for rows, columns in shapes:
        head = "<tr>" + "".join(f"<th>h{c}</th>" for c in range(columns)) + "</tr>"
        body = "".join("<tr>" + "".join(f"<td>{r}.{c}</td>" for c in range(columns)) + "</tr>" for r in range(rows))
        items = "".join(f"<li>i{r}</li>" for r in range(rows))
        docs.append(f"<table>{head}{body}</table><ul>{items}</ul><pre><code>c</code></pre>")
    for (rows, columns), markdown in zip(shapes, converted(html_to_markdown(make_pages(docs)))):
        lines = markdown.split("\n")
        table = [line for line in lines if line.startswith("|")]
        assert len(table) == rows + 2
        assert {line.count("|") for line in table} == {columns + 1}
        assert [line for line in lines if line.startswith("- ")] == [f"- i{r}" for r in range(rows)]
        assert sum(line.startswith("```") for line in lines) == 2


def test_nesting_deeper_than_usual(make_pages):
    docs = ["<ul><li>a" * 9 + "</ul>" * 9 + "<p>z", "<p>flat</p>", "<ol><li>b" * 7]
    deep, flat, ordered = converted(html_to_markdown(make_pages(docs)))
    assert flat == "flat"
    assert deep.split("\n")[-1] == "z" and deep.count("a") >= 9
    assert ordered.count("b") >= 7


def test_levels_take_no_arrays_of_ancestor_rows(make_pages):
    """A node's ancestors stay numbers; their tags are looked up once a page."""
    from pageloom.operators.content import page_nodes, whole_body
    from pageloom.operators.markdown import fragments

    depth = 40
    html = "<ul><li>" * depth + "x" + "</li></ul>" * depth
    found = fragments(whole_body(page_nodes(make_pages([html]), noise=True)))
    assert "reverse(" not in found._jdf.queryExecution().analyzed().toString()
    levels = found.selectExpr("array_sort(array_distinct(transform(filter(pool, f -> f.kind = 'box li'), f -> f.level))) AS l")
    assert levels.first().l == list(range(2, 2 * depth + 1, 2))
    assert converted(html_to_markdown(make_pages(["<ul><li>" * 3 + "x" + "</li></ul>" * 3]))) == ["- - - x\n- x\n- - x\n- x"]


def plain_page(k):
    cells = "".join(f"<tr><td>{name}</td><td>{k}</td></tr>" for name in ("key", "status", "priority"))
    return f"<p>order</p><table><tr><th>field</th><th> value</th></tr>{cells}</table>"


def test_whole_bodies_leave_the_parser_as_markdown(make_pages):
    """No tree of a page is carried to expressions, and time on small pages is a small part of theirs."""
    pages = make_pages([plain_page(k) for k in range(8000)]).repartition(8).cache()
    pages.count()

    def expressions(found):
        return to_markdown(whole_body(page_nodes(found, noise=True)))

    plan = html_to_markdown(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "nodes" not in plan and "lambdafunction" not in plan

    def seconds(convert):
        begin = time.time()
        convert(pages).write.format("noop").mode("overwrite").save()
        return time.time() - begin

    for convert in (expressions, html_to_markdown):
        seconds(convert)
    assert seconds(html_to_markdown) < seconds(expressions) / 2
    pages.unpersist()


def random_soup(rng):
    """Tags in any order, most of them plain, with texts of all kinds between."""
    tags = "table tr td th tbody p ul ol li a b i h1 h2 div span pre code blockquote img hr caption select".split()
    texts = ["", "x", " ", "\n", " a\nb ", "&amp;", "&lt", "<", "a < b", "\xa0k　", "|", "|y|", "<!-- <td>z</td> -->"]
    out = ""
    for _ in range(rng.randint(0, 40)):
        tag, kind = rng.choice(tags), rng.random()
        attrs = rng.choice(["", "", "", " class='language-q'", " href=u&amp;v", " src=s alt='t'", " /"])
        out += f"</{tag}>" if kind < 0.35 else f"<{tag}{attrs}>" if kind < 0.7 else rng.choice(texts)
    return out


def test_whole_bodies_equal_the_expressions(make_pages):
    rng = random.Random(23)
    docs = [random_soup(rng) for _ in range(500)] + [random_html(rng, 4) for _ in range(200)]
    docs += ["", "<", "<td>x", "<table><tr><td>1<table><tr><th>2<td>3</table><td>4</table>", "<ul><li>" * 8 + "x"]
    pages = make_pages(docs)
    want = converted(to_markdown(whole_body(page_nodes(pages, noise=True))))
    for html, markdown, other in zip(docs, converted(html_to_markdown(pages)), want):
        assert markdown == other, html


def test_whole_bodies_take_missing_values(spark):
    rows = [(None, "u", "<p>a"), (1, None, "<ol><li>b"), (2, "v", None), (2, "v", "<hr>"), (2, "v", "<hr>")]
    found = html_to_markdown(spark.createDataFrame(rows, PAGE_SCHEMA)).collect()
    assert sorted(map(str, map(tuple, found))) == [
        "(1, None, '1. b')", "(2, 'v', '---')", "(2, 'v', '---')", "(None, 'u', 'a')"
    ]


def test_long_batches_are_given_in_pieces(monkeypatch):
    monkeypatch.setattr(dom, "CHARACTERS_PER_BATCH", 10)
    texts = ["<p>" + "x" * n for n in (3, 12, 0, 4, 5, 6, 1)]
    batch = pa.RecordBatch.from_pydict({"page_id": range(7), "url": [str(n) for n in range(7)], "html": texts})
    found = list(dom._markdown_batches(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in found] == [2, 4, 1]
    rows = [row for b in found for row in b.to_pylist()]
    assert rows == [{"page_id": n, "url": str(n), "markdown": texts[n][3:]} for n in range(7)]


def test_trees_of_whole_bodies_are_freed_at_once():
    page = "<title>t</title><!--c--><p>a<b>x<p>y</b><table><tr><td>1<td>2</table><ul><li>q<li>r</ul><a href=q>s</a>"
    gc.collect()
    gc.disable()
    try:
        for _ in range(200):
            body_markdown(TreeBuilder(page).build())
        assert gc.collect() < 200
    finally:
        gc.enable()

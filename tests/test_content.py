import pytest

from pageloom.operators.content import (
    best_candidates,
    body_text,
    content_html,
    content_roots,
    main_content,
    score_nodes,
    page_nodes,
)
from pageloom.plans.convert import pages_to_content

LONG = "word " * 40  # 199 bytes after trimming


def htmls(frame):
    return [r.html for r in frame.orderBy("page_id").collect()]


def test_roots(make_pages):
    docs = [
        "<main>m</main><article>a</article><article>b</article>",
        "<div class=content>x</div><main>m</main>",
        "<aside><article>gone</article></aside><p>body</p>",
        f"<div class=post>short</div><div class='entry x'>{LONG}</div>",
        "<div class=post>short</div><div class=entry>short too</div>",
        f"<div class=post>{LONG}</div><div class='post sidebar-x'>{LONG}{LONG}</div>",
        f"<div class=post>{LONG}<a>{LONG}{LONG}</a></div><div class=entry>{LONG}</div>",
        "<body class=menu><p>x</p></body>",
        "<html class=social><p>x</p>",
        "",
    ]
    got = {r.page_id: (r.root_id, r.root_tag) for r in content_roots(page_nodes(make_pages(docs))).collect()}
    tags = [got[i][1] for i in range(len(docs))]
    assert tags == ["article", "main", "body", "div", "div", "div", "div", None, None, "body"]
    # first article in the document; best candidate; first of the zero-scored; more text wins
    assert [got[i][0] for i in (0, 3, 4, 5, 6)] == [5, 5, 3, 5, 7]


def test_score(make_pages):
    html = (
        f"<div id=A class=post><p>{LONG}</p><ul><li><a href=x>link</a></li></ul><img></div>"
        f"<div id=header class=entry>\n {LONG} \n<script>ignored</script></div>"
        "<div class=content>tiny</div>"
        f"<div class=post-content>{LONG}</div><div class=entry>{'é' * 50} </div>"
    )
    nodes = page_nodes(make_pages([html]))
    cands = "x.kind = 'element' AND x.tag = 'div'"
    rows = score_nodes(nodes, cands).orderBy("node_id").collect()
    # post: +50; header holds both "ad" and "header": -200; post-content: "content" and "post"
    sizes = [len(LONG) + 4, len(LONG) - 1, 4, len(LONG) - 1, 100]
    assert [r.bytes for r in rows] == sizes
    assert [r.score for r in rows] == [
        sizes[0] + 10 + 5 + 2 + 50,
        sizes[1] + 50 - 200,
        0,
        sizes[3] + 50 + 50,
        150,
    ]
    assert [(r.n_p, r.n_list, r.n_img, r.link_bytes) for r in rows][0] == (1, 1, 1, 4)
    best = best_candidates(nodes, cands).collect()
    assert len(best) == 1 and best[0].n_candidates == 5
    assert best[0].best.n == rows[3].node_id


CLEAN = [
    ("<article><h1>T</h1><p><b>X<br><p>Y</p><p>Z</p></article>",
     "<h1>T</h1><p><b>X</b></p><p><b>Y</b></p><p><b>Z</b></p>"),
    ("<article><p>t<img src=i></p></article>", "<p>t</p>"),
    ("<article><p>&nbsp;</p><span>&nbsp;</span><p><img></p></article>", "<span>\xa0</span>"),
    ("<article><span><i></i></span><div> <!--c--></div><u><!--c--></u></article>",
     "<span></span><u><!--c--></u>"),
    ("<article><a class=k href='/q?a=1&amp;b'><img></a>x<em id=i lang=en>y</em></article>",
     '<a class="k" href="/q?a=1&amp;b"></a>x<em lang="en">y</em>'),
    ("<article>a<br>b<script>1</script>c &lt; d</article>", "abc &lt; d"),
    ("<article><pre><code class=language-go>x\n</code></pre></article>", "<pre><code>x\n</code></pre>"),
    ("<article><table><tr><td></td><td>2</td></tr></table></article>",
     "<table><tbody><tr><td>2</td></tr></tbody></table>"),
    ("<nav>n</nav><article><header>h</header>it's \"q\"<div class='x ad'>ad</div></article>",
     "it&#39;s &#34;q&#34;"),
    ("<body class=menu><p>x</p></body>", ""),
    ("", ""),
]


def test_clean(make_pages):
    pages = make_pages([html for html, _ in CLEAN])
    assert htmls(pages_to_content(pages)) == [want for _, want in CLEAN]


def test_keep_media(make_pages):
    pages = make_pages(["<article><p><img src=i></p>a<br>b<hr><i></i><div> </div></article>"])
    got = htmls(content_html(main_content(page_nodes(pages), keep_media=True)))
    assert got == ['<p><img src="i"/></p>a<br/>b<hr/>']


def test_text(make_pages):
    docs = [
        "<title>t</title><h1>Title</h1><p>Paragraph 1</p><script>s</script><p>Paragraph 2</p>",
        " <div>a\n\n\n\n\nb</div>\xa0 ",
        "<style>x</style>",
        "<nav>n</nav><noscript><i>raw</i></noscript>",
    ]
    got = {r.page_id: r.text for r in body_text(make_pages(docs)).collect()}
    assert got == {0: "TitleParagraph 1Paragraph 2", 1: "a\n\n\n\nb", 2: "", 3: "n<i>raw</i>"}


@pytest.mark.parametrize("missing", [None])
def test_failed_capture_gives_nothing(make_pages, missing):
    pages = make_pages(["<p>x</p>", missing])
    assert [r.page_id for r in pages_to_content(pages).collect()] == [0]

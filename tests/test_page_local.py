"""The chain from trees to Markdown stays within rows: scans, scores and plans."""

import itertools
import random
import time

import pytest

from pageloom.functions.arrays import least_ahead, running, running_max
from pageloom.operators.content import page_nodes, score_nodes
from pageloom.plans.convert import html_to_markdown, pages_to_content, pages_to_markdown
from pageloom.sources.pages import PAGE_SCHEMA
from pageloom.sources.tree import TreeBuilder, flatten

WS = "\t\n\x0b\x0c\r \x85\xa0   　"


def test_scans_equal_plain_ones(spark):
    rng = random.Random(5)
    rows = [(n, [rng.randint(-9, 9) for _ in range(n)]) for n in (0, 1, 2, 255, 256, 257, 512, 513, 1000)]
    df = spark.createDataFrame(rows, "n int, v array<int>").selectExpr(
        "n", f"{running('v', lambda a, b: f'{a} + {b}')} AS sums", f"{running_max('v')} AS tops",
        f"{least_ahead('v')} AS least",
    )
    got = {r["n"]: r for r in df.collect()}
    for n, v in rows:
        assert got[n]["sums"] == list(itertools.accumulate(v))
        assert got[n]["tops"] == list(itertools.accumulate(v, max))
        assert got[n]["least"] == list(itertools.accumulate(v[::-1], min))[::-1]


def random_page(rng, depth):
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice("p ul a div section img nav b span".split())
        inner = random_page(rng, depth - 1) if depth and rng.random() < 0.8 else ""
        text = rng.choice(["", " ", "\xa0", " kä ", "x\n", "  word word "])
        cls = rng.choice(["", " class='post'", " class='ad'", " id=main class='entry x'"])
        out += f"{rng.choice(['', ' t '])}<{tag}{cls}>{text}{inner}" + ("" if tag == "img" else f"</{tag}>")
    return out


def scores(html):
    """What the scores are made of, node by node and text by text."""
    rows, ends = flatten(TreeBuilder(html).build())
    noise = "script style nav header footer aside iframe embed object".split()
    classes = "ad advertisement sidebar navigation menu social share comments comment".split()
    gone = set()
    for node, here, *_ in rows:
        named = (node.attrs or {}).get("class", "").split() if node.kind == "element" else []
        if node.kind == "element" and (node.tag in noise or set(named) & set(classes)):
            gone |= set(range(here, ends[here] + 1))

    def text(first, last):
        return "".join(rows[i][0].text for i in range(first, last + 1) if rows[i][0].kind == "text" and i not in gone)

    found = {}
    for node, here, *_ in rows:
        if node.kind != "element" or node.tag != "div" or here in gone:
            continue
        inside = [i for i in range(here + 1, ends[here] + 1) if i not in gone and rows[i][0].kind == "element"]
        tags = [rows[i][0].tag for i in inside]
        links = "".join(text(i, ends[i]) + " " for i in inside if rows[i][0].tag == "a")
        found[here] = (
            len(text(here, ends[here]).strip(WS).encode()), tags.count("p"), tags.count("ul") + tags.count("ol"),
            tags.count("img"), len(links.strip(WS).encode()),
        )
    return found


def test_scores_equal_brute_force(spark, make_pages):
    rng = random.Random(11)
    docs = [f"<div>{random_page(rng, rng.randint(0, 4))}</div>{random_page(rng, 2)}" for _ in range(150)]
    got = {}
    for r in score_nodes(page_nodes(make_pages(docs)), "x.kind = 'element' AND x.tag = 'div'").collect():
        got.setdefault(r.page_id, {})[r.node_id] = (r.bytes, r.n_p, r.n_list, r.n_img, r.link_bytes)
    for i, html in enumerate(docs):
        assert got.get(i, {}) == scores(html), html


@pytest.mark.parametrize("convert", [pages_to_markdown, pages_to_content, html_to_markdown])
def test_nothing_is_shuffled_or_stored_after_the_parse(spark, convert):
    plan = convert(spark.read.schema(PAGE_SCHEMA).parquet("/root/testdata/sf0.001/pages.parquet"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("MapInArrow")]
    for step in ("Repartition", "Aggregate", "Join", "Window", "Sort "):
        assert step not in above
    assert text.count("MapInArrow") == 1 and "pages.parquet" not in above


def test_time_follows_the_blocks(spark):
    """Four times the blocks take about four times as long: scores, cleaning and folding."""
    def page(blocks):
        body = "".join(f"<div class='post'><p>word {i} <a href=x>link</a></p><ul><li>i</ul></div>" for i in range(blocks))
        return spark.createDataFrame([(0, "https://h.example/", f"<body>{body}")], PAGE_SCHEMA)

    def seconds(blocks):
        begin = time.time()
        assert len(html_to_markdown(page(blocks)).collect()) == len(pages_to_content(page(blocks)).collect()) == 1
        return time.time() - begin

    seconds(500)
    small, large = seconds(1500), seconds(6000)
    assert large < 10 * small

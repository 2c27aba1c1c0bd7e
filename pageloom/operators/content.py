"""Main content of a page: strip noise, choose the root, clean what is below it.

A page is one row whose ``nodes`` are an array in document order, so all steps
are expressions over that row: nothing is shuffled or stored after the parse,
and a stream of pages is converted like a table of them.

Subtree tests use intervals in document order.  Intervals of a tree are nested,
so "inside a marked subtree" is a running maximum of the marked nodes' ends, and
"holds something solid" is the least place of something solid from here on.
Sums over a subtree are differences of running sums at its first and last node.
All scans take time in proportion to the nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.arrays import bind, least_ahead, running, running_max
from pageloom.functions.text import WHITE_SPACE, is_ascii_blank, is_blank, let, literal, squeeze
from pageloom.sources.dom import page_trees

# What is removed before content is chosen.
NOISE_TAGS = "script style nav header footer aside iframe embed object".split()
NOISE_CLASSES = (
    "ad advertisement sidebar navigation menu social share comments comment".split()
)
# Classes of content containers, and words that raise or lower a score.
CONTAINER_CLASSES = ["content", "post", "article", "entry", "post-content"]
GOOD_WORDS = ["content", "article", "post", "entry", "main", "body"]
BAD_WORDS = ["ad", "advertisement", "sidebar", "nav", "menu", "footer", "header"]
DROPPED_ATTRIBUTES = ["class", "id", "style", "onclick"]
MIN_BYTES, MAX_LINK_DENSITY = 100, 0.5
MEDIA = ["img", "br", "hr"]

NEVER = 2**31 - 1
NODE = "struct<n:int,end:int,parent:int,kind:string,tag:string,text:string,attrs:map<string,string>,up:array<int>>"
_PLACE = "named_struct('n', x.n, 'end', x.end, 'tag', x.tag, 'depth', size(x.up))"


def _strings(values: Sequence[str]) -> str:
    return f"array({', '.join(literal(v) for v in values)})"


def _has_class(classes: Sequence[str]) -> str:
    tokens = r"split(x.attrs['class'], '[\\t\\n\\f\\r ]+')"
    return f"coalesce(arrays_overlap({tokens}, {_strings(classes)}), false)"


_IS_NOISE = f"x.kind = 'element' AND (array_contains({_strings(NOISE_TAGS)}, x.tag) OR {_has_class(NOISE_CLASSES)})"
IS_CONTAINER = f"x.kind = 'element' AND {_has_class(CONTAINER_CLASSES)}"


def _reach(nodes: str, marked: str) -> str:
    """For each node the last one that a marked node up to it reaches."""
    return running_max(f"transform({nodes}, (x, i) -> if({marked}, x.end, -1))")


def page_nodes(pages: DataFrame, *, noise: bool = False) -> DataFrame:
    """``(page_id, url, nodes, gone)``: pages parsed once, and for each node whether it lies in noise.

    With ``noise`` nothing is noise (converting HTML as it is).
    """
    trees = page_trees(pages)
    if noise:
        return bind(trees, gone="array_repeat(false, size(nodes))")
    return bind(bind(trees, _noise=_reach("nodes", _IS_NOISE)), gone="transform(nodes, (x, i) -> _noise[i] >= i)").drop(
        "_noise"
    )


# -- scores ---------------------------------------------------------------------------------


def _sums(nodes: str, gone: str) -> str:
    """``array<struct<b, p, l, i>>``: running sums of text bytes and of paragraphs, lists and images."""
    def one(test: str) -> str:
        return f"if(NOT {gone}[i] AND x.kind = 'element' AND {test}, 1, 0)"

    each = (
        f"transform({nodes}, (x, i) -> named_struct('b', if(NOT {gone}[i] AND x.kind = 'text', octet_length(x.text), 0),"
        f" 'p', {one("x.tag = 'p'")}, 'l', {one("x.tag IN ('ul', 'ol')")},"
        f" 'i', {one("x.tag = 'img'")}))"
    )

    def add(a: str, b: str) -> str:
        return f"named_struct({', '.join(f'{literal(k)}, {a}.{k} + {b}.{k}' for k in 'bpli')})"

    return running(each, add)


def _blank_bytes(text: str, side: str) -> str:
    """Bytes of white space that trimming cuts at one end."""
    return f"(octet_length({text}) - octet_length(trim({side} {literal(WHITE_SPACE)} FROM {text})))"


_EMPTY_SUMS = "CAST(array() AS array<struct<b:int,p:int,l:int,i:int>>)"


def with_sums(trees: DataFrame, needed: str = "true") -> DataFrame:
    """Adds what scores are made of, for pages where ``needed`` holds.

    ``s_sum``: running sums; ``s_next``, ``s_last``: the next and the last text
    that is not blank, by node; ``a_sum``, ``a_next``, ``a_last``: the same for
    the bytes of links (each with a space after it) and links with text.
    """
    none = "CAST(array() AS array<int>)"
    filled = f"NOT gone[i] AND x.kind = 'text' AND NOT {is_blank('x.text')}"
    df = bind(
        trees,
        s_sum=f"if({needed}, {_sums('nodes', 'gone')}, {_EMPTY_SUMS})",
        s_next=f"if({needed}, {least_ahead(f'transform(nodes, (x, i) -> if({filled}, i, {NEVER}))')}, {none})",
        s_last=f"if({needed}, {running_max(f'transform(nodes, (x, i) -> if({filled}, i, -1))')}, {none})",
    )
    link = "NOT gone[i] AND x.kind = 'element' AND x.tag = 'a'"
    shown = f"{link} AND s_next[i] <= x.end"
    size = f"if({link}, s_sum[x.end].b - s_sum[i].b + 1, 0)"
    return bind(
        df,
        a_sum=f"if({needed}, {running(f'transform(nodes, (x, i) -> {size})', lambda a, b: f'{a} + {b}')}, {none})",
        a_next=f"if({needed}, {least_ahead(f'transform(nodes, (x, i) -> if({shown}, i, {NEVER}))')}, {none})",
        a_last=f"if({needed}, {running_max(f'transform(nodes, (x, i) -> if({shown}, i, -1))')}, {none})",
    )


def _before_text(n: str) -> str:
    """Bytes of the subtree of node ``n`` before its first visible character."""
    first = f"s_next[{n}]"
    return (
        f"(s_sum[{first}].b - octet_length(nodes[{first}].text) - s_sum[{n}].b"
        f" + {_blank_bytes(f'nodes[{first}].text', 'LEADING')})"
    )


def _after_text(end: str) -> str:
    """Bytes of a subtree that ends with node ``end`` behind its last visible character."""
    last = f"s_last[{end}]"
    return f"(s_sum[{end}].b - s_sum[{last}].b + {_blank_bytes(f'nodes[{last}].text', 'TRAILING')})"


def _scored(candidate: str) -> str:
    """``struct<n, end, tag, depth, bytes, n_p, n_list, n_img, link_bytes, score>`` of node ``candidate``."""
    def measured(x: str) -> str:
        total = f"s_sum[{x}.end].b - s_sum[{x}.n].b"
        size = f"if(s_next[{x}.n] > {x}.end, 0, {total} - {_before_text(f'{x}.n')} - {_after_text(f'{x}.end')})"
        # Links strictly inside, from the first with text to the last; a link cannot be the last node's end.
        first, last = f"a_next[{x}.n + 1]", f"a_last[{x}.end]"
        links = (
            f"if({x}.n = {x}.end OR {first} > {x}.end, 0, a_sum[{last}] - a_sum[{first} - 1]"
            f" - {_before_text(first)} - {_after_text(f'nodes[{last}].end')} - 1)"
        )
        counts = ", ".join(
            f"'{name}', CAST(s_sum[{x}.end].{k} - s_sum[{x}.n].{k} AS BIGINT)"
            for name, k in (("n_p", "p"), ("n_list", "l"), ("n_img", "i"))
        )
        return f"named_struct('x', {x}, 'bytes', {size}, {counts}, 'link_bytes', {links})"

    def rated(m: str) -> str:
        named = f"lower(coalesce({m}.x.attrs['class'], '')), lower(coalesce({m}.x.attrs['id'], ''))"

        def hits(words: Sequence[str]) -> str:
            return f"size(filter({_strings(words)}, w -> exists(array({named}), name -> contains(name, w))))"

        score = f"""
            CASE WHEN {m}.bytes < {MIN_BYTES} THEN 0
                 WHEN {m}.link_bytes / {m}.bytes > {MAX_LINK_DENSITY} THEN 0
                 ELSE {m}.bytes + 10 * {m}.n_p + 5 * {m}.n_list + 2 * {m}.n_img
                      + 50 * {hits(GOOD_WORDS)} - 100 * {hits(BAD_WORDS)} END"""
        kept = ", ".join(f"'{k}', {m}.{k}" for k in ("bytes", "n_p", "n_list", "n_img", "link_bytes"))
        place = f"'n', {m}.x.n, 'end', {m}.x.end, 'tag', {m}.x.tag, 'depth', size({m}.x.up)"
        return f"named_struct({place}, {kept}, 'score', CAST({score} AS DOUBLE))"

    return let(let(candidate, measured), rated)


def _candidates(test: str) -> str:
    return f"filter(nodes, (x, i) -> NOT gone[i] AND {test})"


def score_nodes(trees: DataFrame, test: str) -> DataFrame:
    """``(page_id, node_id, tag, bytes, n_p, n_list, n_img, link_bytes, score)`` of all nodes ``x`` that meet ``test``.

    Text lengths are UTF-8 bytes after trimming; a node with less than 100
    bytes, or more than half of them in links, scores 0.
    """
    found = with_sums(trees).selectExpr("page_id", f"inline(transform({_candidates(test)}, c -> {_scored('c')}))")
    return found.withColumnRenamed("n", "node_id").drop("end", "depth")


def best_candidates(trees: DataFrame, test: str) -> DataFrame:
    """Per page the best-scored node; the first wins ties and if none is above 0.

    Gives ``(page_id, best(n, end, tag, depth), score, n_candidates)``, one row
    for each page that has any.
    """
    scored = bind(with_sums(trees), _scored=f"transform({_candidates(test)}, c -> {_scored('c')})")
    return bind(scored.where("size(_scored) > 0"), _best=_best("_scored")).selectExpr(
        "page_id", "named_struct('n', _best.n, 'end', _best.end, 'tag', _best.tag, 'depth', _best.depth) AS best",
        "greatest(_best.score, 0D) AS score", "size(_scored) AS n_candidates",
    )


def _best(scored: str) -> str:
    better = "if(greatest(c.score, 0D) > greatest(b.score, 0D), c, b)"
    return f"aggregate(slice({scored}, 2, size({scored})), {scored}[0], (b, c) -> {better})"


# -- roots ----------------------------------------------------------------------------------


def with_roots(trees: DataFrame) -> DataFrame:
    """Adds ``root`` ``(n, end, tag, depth)``: NULL if all of a page is noise.

    First ``article``, else first ``main``, else the best container by class,
    else ``body``.  Only pages without article and main are scored.
    """
    def first(tag: str) -> str:
        test = f"NOT gone[i] AND x.kind = 'element' AND x.tag = '{tag}'"
        return f"get(transform(filter(nodes, (x, i) -> {test}), x -> {_PLACE}), 0)"

    named = bind(trees, _named=f"coalesce({first('article')}, {first('main')})")
    listed = bind(named, _listed=f"if(_named IS NULL, {_candidates(IS_CONTAINER)}, CAST(array() AS array<{NODE}>))")
    rated = bind(
        with_sums(listed, "size(_listed) > 0"), _rated=f"transform(_listed, c -> {_scored('c')})"
    )
    place = "named_struct('n', b.n, 'end', b.end, 'tag', b.tag, 'depth', b.depth)"
    best = f"if(size(_rated) = 0, NULL, transform(array({_best('_rated')}), b -> {place})[0])"
    rooted = bind(rated, root=f"coalesce(_named, {best}, {first('body')})")
    return rooted.select(*trees.columns, "root")


def content_roots(trees: DataFrame) -> DataFrame:
    """``(page_id, url, root_id, root_end, root_tag)``, one row per page; NULL root if all is noise."""
    return with_roots(trees).selectExpr(
        "page_id", "url", "root.n AS root_id", "root.end AS root_end", "root.tag AS root_tag"
    )


def below_roots(rooted: DataFrame) -> DataFrame:
    """``(page_id, url, tags, content)``: nodes strictly below the root, ancestors counted from the root down.

    ``tags`` are the tags of all nodes of the page, by number.
    """
    inside = "root IS NOT NULL AND NOT gone[i] AND i > root.n AND i <= root.end"
    cut = (
        "named_struct('n', x.n, 'end', x.end, 'parent', x.parent, 'kind', x.kind, 'tag', x.tag, 'text', x.text,"
        " 'attrs', x.attrs, 'up', slice(x.up, root.depth + 2, size(x.up)))"
    )
    return bind(
        rooted, tags="transform(nodes, x -> x.tag)",
        content=f"transform(filter(nodes, (x, i) -> {inside}), x -> {cut})",
    ).select("page_id", "url", "tags", "content")


# -- cleaning -------------------------------------------------------------------------------


def flag_clean(below: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """Adds ``dropped``, by node: blank paragraphs and divs, then blank elements without markup inside.

    Void elements (images, breaks) hold neither text nor markup, so they go too
    unless ``keep_media`` is set.
    """
    media = f"array_contains({_strings(MEDIA)}, x.tag)" if keep_media else "false"
    filled = f"(x.kind = 'text' AND NOT {is_blank('x.text')}) OR (x.kind = 'element' AND {media})"
    df = bind(below, _filled=least_ahead(f"transform(content, x -> if({filled}, x.n, {NEVER}))"))
    block = "x.kind = 'element' AND x.tag IN ('p', 'div') AND _filled[i] > x.end"
    df = bind(df, _first=_reach("content", block))
    solid = f"_first[i] < x.n AND (x.kind != 'text' OR NOT {is_ascii_blank('x.text')})"
    df = bind(df, _solid=least_ahead(f"transform(content, (x, i) -> if({solid}, x.n, {NEVER}))"))
    hollow = (
        f"_first[i] < x.n AND x.kind = 'element' AND coalesce(get(_solid, i + 1), {NEVER}) > x.end AND NOT {media}"
    )
    df = bind(df, _hollow=_reach("content", hollow))
    dropped = "transform(content, (x, i) -> _first[i] >= x.n OR _hollow[i] >= x.n)"
    return bind(df, dropped=dropped).drop("_filled", "_first", "_solid", "_hollow")


def clean_content(below: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """``content`` without what cleaning drops.

    Text nodes that became neighbours count as one text.  Presentation
    attributes go, except on images and links.
    """
    flagged = flag_clean(below, keep_media=keep_media)
    kept = bind(flagged.select("page_id", "url", "tags", "content", "dropped"),
                _kept="filter(content, (x, i) -> NOT dropped[i])")
    follows = (
        "x.kind = 'text' AND i > 0 AND get(_kept, i - 1).kind = 'text' AND get(_kept, i - 1).parent = x.parent"
    )
    heads = bind(kept, _heads=f"filter(transform(_kept, (x, i) -> if({follows}, -1, i)), i -> i >= 0)")
    run = "slice(_kept, h + 1, coalesce(get(_heads, j + 1), size(_kept)) - h)"
    attrs = (
        f"if(x.tag IN ('img', 'a'), x.attrs, map_filter(x.attrs, (k, v) -> NOT array_contains({_strings(DROPPED_ATTRIBUTES)}, k)))"
    )
    joined = (
        f"transform(_heads, (h, j) -> {let('_kept[h]', lambda x: _node(x, run, attrs))})"
    )
    return bind(heads.drop("content"), content=joined).select("page_id", "url", "tags", "content")


def _node(x: str, run: str, attrs: str) -> str:
    text = f"if({x}.kind = 'text', array_join(transform({run}, y -> y.text), ''), {x}.text)"
    return (
        f"named_struct('n', {x}.n, 'end', {x}.end, 'parent', {x}.parent, 'kind', {x}.kind, 'tag', {x}.tag,"
        f" 'text', {text}, 'attrs', {attrs.replace('x.', x + '.')}, 'up', {x}.up)"
    )


def main_content(trees: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """Cleaned content of every page: ``(page_id, url, tags, content)``."""
    return clean_content(below_roots(with_roots(trees)), keep_media=keep_media)


def whole_body(trees: DataFrame) -> DataFrame:
    """Everything below ``body``, nothing removed (converting HTML as it is)."""
    body = f"transform(filter(nodes, x -> x.kind = 'element' AND x.tag = 'body'), x -> {_PLACE})"
    return below_roots(bind(trees, root=f"get({body}, 0)"))


# How a tree is written out.
_VOID = "area base br col embed hr img input keygen link meta param source track wbr".split()
_RAW = "iframe noembed noframes noscript plaintext script style xmp".split()


def _escaped(text: str) -> str:
    out = text
    for char, name in (("&", "&amp;"), ("\\'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("\\r", "&#13;")):
        out = f"replace({out}, '{char}', '{name}')"
    return out


def content_html(content: DataFrame) -> DataFrame:
    """``(page_id, url, html)``: the content written out as HTML.

    Start tags and texts sort by their own position, end tags by the end of
    their element, inner ones first.
    """
    attributes = f"""array_join(transform(map_entries(coalesce(x.attrs, map())),
        e -> concat(' ', e.key, '="', {_escaped('e.value')}, '"')), '')"""
    is_void = f"array_contains({_strings(_VOID)}, x.tag)"
    start = f"concat('<', x.tag, {attributes}, if({is_void}, '/>', '>'))"
    here = "x.n AS at, 0 AS side, 0 AS inner"
    pieces = f"""
        CASE x.kind
          WHEN 'text' THEN array(struct({here},
               if(array_contains({_strings(_RAW)}, x.tag), x.text, {_escaped('x.text')}) AS piece))
          WHEN 'comment' THEN array(struct({here}, concat('<!--', x.text, '-->') AS piece))
          ELSE array(struct({here}, {start} AS piece),
                     struct(x.end AS at, 1 AS side, -x.n AS inner,
                            if({is_void}, '', concat('</', x.tag, '>')) AS piece)) END"""
    ordered = f"array_sort(flatten(transform(content, x -> {pieces})))"
    return content.selectExpr("page_id", "url", f"array_join(transform({ordered}, p -> p.piece), '') AS html")


def body_text(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``: text of the body without scripts and styles, trimmed."""
    shown = "x.kind = 'text' AND x.tag NOT IN ('script', 'style') AND exists(x.up, a -> nodes[a].tag = 'body')"
    text = f"array_join(transform(filter(nodes, x -> {shown}), x -> x.text), '')"
    return bind(page_trees(pages, ["kind", "tag", "text", "up"]), _text=text).selectExpr(
        "page_id", f"replace({squeeze('_text')}, '\\n\\n\\n', '\\n\\n') AS text"
    )

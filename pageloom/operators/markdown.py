"""Markdown of page content, built from the bottom up within each page.

Every text or element below the root is a *fragment* of the containers that
show it.  Tags like headings, links and code swallow all text below them;
paragraphs, lists, list items, table rows and tables are containers; any other
tag is transparent.  The fragments of a page are one array.  A fold over its
nesting levels, innermost first, turns the containers of a level into fragments
of the levels above, and what the root shows makes the document.  A list shows
every item below it at any depth and an item shows its own content, so nested
items appear more than once.

All of it is expressions over one row per page: no shuffle, no stored table, and
each page goes as many levels as it has.

``sources/fold.py`` has the same rules for whole bodies, which are rendered where they
are parsed; a change here is one there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.functions.arrays import bind
from pageloom.functions.text import extract, is_blank, let, literal, squeeze, substitute

# How tags are rendered.
SWALLOWING = "h1 h2 h3 h4 h5 h6 blockquote pre code a strong b em i img hr".split()
CONTAINERS = "p ul ol li tr table".split()
ROOT = -1

_NO_TARGETS = "cast(NULL AS array<struct<id: int, level: int>>)"

# What the tag of an ancestor means for the nodes below it, as bits of a number a node.
_BITS = {
    "box": CONTAINERS, "stop": [*SWALLOWING, "table", "p", "ul", "ol"], "taker": [*SWALLOWING, "td", "th"],
    "li": ["li"], "p": ["p"], "list": ["ul", "ol"], "tr": ["tr"], "table": ["table"], "pre": ["pre"],
}
_MARKED = sorted({tag for tags in _BITS.values() for tag in tags})


def _one_of(tag: str, tags: list[str]) -> str:
    return f"{tag} IN ({', '.join(literal(t) for t in tags)})"


def _marks() -> str:
    """For each node of the page the bits of its tag."""
    values = [sum(1 << k for k, tags in enumerate(_BITS.values()) if tag in tags) for tag in _MARKED]
    listed = f"array(0, {', '.join(map(str, values))})"
    return f"transform(tags, t -> {listed}[find_in_set(t, {literal(','.join(_MARKED))})])"


def _is(name: str, node: str) -> str:
    return f"(marks[{node}] & {1 << list(_BITS).index(name)}) != 0"


def _level(above: str = "true") -> str:
    """1 plus the number of containers among the ancestors ``b`` of node ``x`` that meet ``above``."""
    return f"(1 + size(filter(x.up, b -> {above} AND {_is('box', 'b')})))"


def _places(test: str) -> str:
    """Ancestors ``a`` of node ``x`` that meet ``test``, with their levels; numbers rise from the root down."""
    return f"transform(filter(x.up, a -> {test}), a -> struct(a AS id, {_level('b < a')} AS level))"


def _receivers() -> str:
    """Containers that show this node: items passed on the way up, then the first paragraph or root."""
    def shown(stop: str) -> str:
        taken = _places(f"a > {stop} AND {_is('li', 'a')} OR a = {stop} AND {_is('p', 'a')}")
        return f"if({stop} = -1, concat({taken}, array(struct({ROOT} AS id, 0 AS level))), {taken})"

    return let(f"coalesce(array_max(filter(x.up, a -> {_is('stop', 'a')})), -1)", shown)


def _targets() -> str:
    """Containers that show an element; NULL if none does."""
    shown = _one_of("x.tag", [*SWALLOWING, "p", "ul", "ol", "table"])
    return f"""
        CASE WHEN x.tag = 'li' THEN {_places(_is('list', 'a'))}
             WHEN x.tag IN ('td', 'th') THEN {_places(_is('tr', 'a'))}
             WHEN x.tag = 'tr' THEN {_places(_is('table', 'a'))}
             WHEN {shown} THEN {_receivers()} END"""


def _row(target: str, level: str, at: str, side: int, kind: str, md: str, targets: str) -> str:
    return (
        f"struct({target} AS target, {at} AS ord, {kind} AS kind, {md} AS md, string(NULL) AS md2,"
        f" {side} AS side, {level} AS level, {targets} AS targets)"
    )


def fragments(content: DataFrame) -> DataFrame:
    """``(page_id, url, pool)``: all fragments before folding, ``array<struct<target, ord, kind, md, ...>>``.

    * ``text``: a text shown by a paragraph, an item or the root.  Directly in a
      paragraph or item it is trimmed and followed by a space even if blank;
      below transparent tags blank texts vanish; directly below the root all
      text is lost.
    * ``raw`` and ``lang``: text, and the class of the first code, for elements
      that swallow what is below them.
    * ``box``: the element itself, which waits for its fragments; ``md`` holds
      what its attributes add.
    * ``edge``: line ends around the children of the root.
    """
    direct = "t.id = coalesce(get(x.up, size(x.up) - 1), -2)"

    def text(squeezed: str) -> str:
        shown = f"(t.id != {ROOT} OR size(x.up) > 0) AND ({direct} OR {squeezed} != '')"
        row = _row("t.id", "t.level", "x.n", 1, "'text'", f"concat({squeezed}, ' ')", _NO_TARGETS)
        return f"transform(filter({_receivers()}, t -> {shown}), t -> {row})"

    raw = _row("t.id", "t.level", "x.n", 1, "'raw'", "x.text", _NO_TARGETS)
    lang = _row("t.id", "t.level", "x.n", 1, "'lang'", "coalesce(x.attrs['class'], '')", _NO_TARGETS)
    note = """CASE x.tag WHEN 'a' THEN coalesce(x.attrs['href'], '')
        WHEN 'img' THEN concat('![', coalesce(x.attrs['alt'], ''), '](', coalesce(x.attrs['src'], ''), ')\\n')
        ELSE '' END"""
    box = _row("x.n", _level(), "x.n", 1, "concat('box ', x.tag)", note, _targets())
    rows = f"""
        CASE x.kind
          WHEN 'text' THEN concat({let(squeeze('x.text'), text)}, transform({_places(_is('taker', 'a'))}, t -> {raw}))
          WHEN 'element' THEN
            if({_is('box', 'x.n')} OR {_is('taker', 'x.n')},
              if(x.tag = 'code', concat(array({box}), transform({_places(_is('pre', 'a'))}, t -> {lang})), array({box})),
              array())
          ELSE array() END"""
    before = "if(x.tag = 'table' AND NOT coalesce(get(_top, i - 1).tag = 'table', false), '\\n', '')"
    after = "if(x.tag = 'table', '\\n', '\\n\\n')"
    edges = ", ".join(
        _row(str(ROOT), "0", at, side, "'edge'", md, _NO_TARGETS)
        for at, side, md in (("x.n", 0, before), ("x.end", 2, after))
    )
    tops = bind(content, marks=_marks(), _top="filter(content, x -> x.kind = 'element' AND size(x.up) = 0)")
    pool = f"concat(flatten(transform(content, x -> {rows})), flatten(transform(_top, (x, i) -> array({edges}))))"
    return bind(tops, pool=pool).select("page_id", "url", "pool")


def _render() -> str:
    """Markdown of a box from its parts; rows also give their body form (``_render_body_row``)."""
    inline = "array_join(transform(_parts, x -> x.md), '')"
    text = squeeze("array_join(transform(filter(_parts, x -> x.kind = 'raw'), x -> x.md), '')")
    lang = "coalesce(get(filter(_parts, x -> x.kind = 'lang'), 0).md, '')"
    lines = (
        f"transform(filter(split({text}, '\\n'), l -> NOT {is_blank('l')}),"
        f" l -> concat('> ', {squeeze('l')}, '\\n'))"
    )
    # The indent is one more than the UTF-8 length of the item number as a character.
    indent = "CASE WHEN i < 127 THEN 2 WHEN i < 2047 THEN 3 WHEN i < 65535 THEN 4 ELSE 5 END"

    def row(cells: str) -> str:
        ruler = f"array_repeat('---', size({cells}))"
        return f"if(size({cells}) > 0, concat({_table_line(cells)}, {_table_line(ruler)}), NULL)"

    rest = "array_join(transform(slice(_parts, 2, size(_parts)), x -> coalesce(x.md2, '')), '')"
    return f"""
        CASE WHEN _box = 'p' THEN concat({squeeze(inline)}, '\\n')
             WHEN _box = 'li' THEN {squeeze(inline)}
             WHEN _box = 'ul' THEN array_join(transform(_parts, x -> concat('- ', x.md, '\\n')), '')
             WHEN _box = 'ol' THEN array_join(transform(_parts,
               (x, i) -> concat(repeat(' ', {indent}), '1. ', x.md, '\\n')), '')
             WHEN _box IN ('td', 'th') THEN {text}
             WHEN _box = 'tr' THEN {let(_cells('td', 'th'), row)}
             WHEN _box = 'table' THEN
               concat('\\n', if(get(_parts, 0).md IS NULL, '', concat(get(_parts, 0).md, {rest})))
             WHEN _box IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN
               concat(repeat('#', int({extract('_box', '[1-6]')})), ' ', {text}, '\\n')
             WHEN _box = 'blockquote' THEN array_join({lines}, '')
             WHEN _box = 'pre' THEN
               concat('```', {substitute(lang, '^language-', '')}, '\\n', {text}, '\\n```\\n')
             WHEN _box = 'code' THEN concat('`', {text}, '`')
             WHEN _box = 'img' THEN _note
             WHEN _box = 'a' THEN concat('[', {text}, '](', _note, ')')
             WHEN _box IN ('strong', 'b') THEN concat('**', {text}, '**')
             WHEN _box IN ('em', 'i') THEN concat('*', {text}, '*')
             WHEN _box = 'hr' THEN '---\\n' END"""


def _cells(*kinds: str) -> str:
    return f"transform(filter(_parts, x -> {_one_of('x.kind', list(kinds))}), x -> x.md)"


def _table_line(cells: str) -> str:
    return f"concat('| ', array_join({cells}, ' | '), ' |\\n')"


def _folded(pool: str, level: str) -> str:
    """``pool`` with the boxes of ``level`` turned into fragments of lower levels; others pass unchanged.

    Fragments of a level are sorted by box, so that each box is a slice of them, which its own row begins.
    """
    def rendered(group: str) -> str:
        def boxed(own: str) -> str:
            def made(box: str) -> str:
                def named(parts: str) -> str:
                    def expression(template: str) -> str:
                        return template.replace("_parts", parts).replace("_box", box).replace("_note", f"{own}.md")

                    body_row = let(_cells("td"), lambda c: f"if(size({c}) > 0, {_table_line(c)}, NULL)")
                    md = f"struct({expression(_render())} AS md, if({box} = 'tr', {expression(body_row)}, NULL) AS md2)"
                    return let(
                        md,
                        lambda m: f"transform({own}.targets, t -> struct(t.id AS target, {own}.target AS ord,"
                        f" {box} AS kind, {m}.md AS md, {m}.md2 AS md2, 1 AS side, t.level AS level,"
                        f" {_NO_TARGETS} AS targets))",
                    )

                return let(f"slice({group}, 2, size({group}))", named)

            made_box = let(f"substring({own}.kind, {len(BOX) + 1})", made)
            return f"if(startswith({own}.kind, {literal(BOX)}), {made_box}, NULL)"

        return let(f"{group}[0]", boxed)

    def grouped(here: str) -> str:
        head = f"i = 0 OR {here}[i].target != get({here}, i - 1).target"
        heads = f"filter(transform({here}, (f, i) -> if({head}, i, -1)), i -> i >= 0)"

        def cut(h: str) -> str:
            group = f"slice({here}, at + 1, coalesce(get({h}, j + 1), size({here})) - at)"
            return f"flatten(filter(transform({h}, (at, j) -> {let(group, rendered)}), r -> r IS NOT NULL))"

        return let(heads, cut)

    here = f"array_sort(filter({pool}, f -> f.level = {level}))"
    return f"concat(filter({pool}, f -> f.level != {level}), {let(here, grouped)})"


BOX = "box "


def root_fragments(content: DataFrame) -> DataFrame:
    """Everything the root shows, rendered: ``(page_id, url, ord, side, kind, md)``."""
    shown = "transform(_rooted, f -> struct(f.ord, f.side, f.kind, f.md))"
    return _rooted(content).selectExpr("page_id", "url", f"inline({shown})")


def _rooted(content: DataFrame) -> DataFrame:
    made = bind(fragments(content), _depth="coalesce(array_max(transform(pool, f -> f.level)), 0)")
    levels = "if(_depth > 0, sequence(_depth, 1, -1), CAST(array() AS array<int>))"
    folded = f"aggregate({levels}, pool, (p, l) -> {_folded('p', 'l')})"
    return bind(made, _rooted=f"filter({folded}, f -> f.target = {ROOT})").select("page_id", "url", "_rooted")


def to_markdown(content: DataFrame) -> DataFrame:
    """``(page_id, url, markdown)`` for every page; empty text if there is no content."""
    ordered = "array_sort(transform(_rooted, f -> struct(f.ord, f.side, f.md)))"
    tidy = substitute("_doc", r"(\|[^\n]*\|)\n\n(\|)", "$1\n$2")
    tidy = squeeze(substitute(tidy, r"\n{4,}", "\n\n\n"))
    joined = bind(_rooted(content), _doc=f"array_join(transform({ordered}, f -> f.md), '')")
    return joined.selectExpr("page_id", "url", f"{tidy} AS markdown")

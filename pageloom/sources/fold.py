"""Page-local helper of the Markdown of whole bodies: a page's tree to text, in one walk.

The rules are those of ``operators/markdown.py``, which writes them as SQL
expressions over the nodes of cleaned content; the tests hold both equal.  Here the
tree is walked where it was parsed, so that a page leaves the parser as its Markdown
and its nodes never leave the task's memory.

On the way down each node finds the boxes that show it; on the way up a box, whose
parts are complete then, becomes a part of the boxes above.
"""

from __future__ import annotations

import re

from pageloom.functions.text import WHITE_SPACE
from pageloom.sources.tree import Node

_HEADINGS = {f"h{k}": f"{'#' * k} " for k in range(1, 7)}
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
# Tags that take all text below them as it is and show nothing else of it.
_SWALLOWING = frozenset((*_HEADINGS, *_MARKS, "blockquote", "pre", "a", "img", "hr"))
_OFTEN_TEXT = frozenset(("p", "li", "td", "th"))
_RENDERED = _SWALLOWING | {"p", "ul", "ol", "li", "table", "tr", "td", "th"}
_SPLIT_TABLE = re.compile(r"(\|[^\n]*\|)\n\n(\|)")
_BLANK_LINES = re.compile(r"\n{4,}")


def body_markdown(root: Node) -> str:
    """Markdown of everything below the body; nodes lose their parents, so that a tree is freed at once."""
    document: list[str] = []
    after_table = False
    body, todo = None, [root]
    while todo:
        node = todo.pop()
        node.parent = None
        if node.tag == "body" and node.kind == "element":
            body = node
        else:
            todo.extend(node.kids)
    for top in body.kids:
        top.parent = None
        if top.kind != "element":  # text directly in the body is not shown
            continue
        is_table = top.tag == "table"
        if is_table and not after_table:
            document.append("\n")
        _add(top, document)
        document.append("\n" if is_table else "\n\n")
        after_table = is_table
    text = "".join(document)
    if "|\n\n|" in text:
        text = _SPLIT_TABLE.sub(r"\1\n\2", text)
    if "\n\n\n\n" in text:
        text = _BLANK_LINES.sub("\n\n\n", text)
    return text.strip(WHITE_SPACE)


def _add(top: Node, document: list[str]) -> None:
    """Adds to ``document`` what it shows of ``top`` and the nodes below.

    A box is the list of its parts: of paragraphs and items strings, of tags that swallow and of cells the texts
    below them, of lists their items, of rows ``(is_data, text)`` by cell, of tables the rows.  Parts come in
    document order: an item, a row or a cell may lie within another one that the same box shows, so it takes its
    place on the way down.
    """
    # The boxes that show a node: paragraph and items, or the document; what takes its text; lists, rows and tables above.
    shown, takers, lists, rows, tables, fences = (document,), (), (), (), (), ()
    own = None  # the box of the element itself
    kids, leave, todo = iter((top,)), None, []
    while True:
        for node in kids:
            node.parent = None
            kind = node.kind
            if kind == "text":
                text = node.text
                if shown:
                    words = text.strip(WHITE_SPACE)
                    for box in shown:
                        if words or box is own:
                            box.append(words + " ")
                for box in takers:
                    box.append(text)
                continue
            if kind != "element":
                continue
            tag = node.tag
            if tag not in _RENDERED:
                if node.kids:
                    todo.append((kids, leave, own, shown, takers, lists, rows, tables, fences))
                    kids, leave, own = iter(node.kids), None, None
                    break
                continue
            inside = node.kids
            if tag in _OFTEN_TEXT and len(inside) == 1 and inside[0].kind == "text":
                _add_text_only(tag, inside[0], shown, takers, lists, rows)
                continue
            box, up = [], (kids, leave, own, shown, takers, lists, rows, tables, fences)
            if tag in ("td", "th"):
                leave = (node, box, rows, _held(rows))
                takers += (box,)
            elif tag == "tr":
                leave = (node, box, tables, _held(tables))
                rows += (box,)
            elif tag == "li":
                leave = (node, box, lists, _held(lists))
                shown += (box,)
            else:
                leave = (node, box, shown, None)
                if tag == "p":
                    shown = (box,)
                else:
                    shown = ()
                    if tag == "table":
                        tables += (box,)
                    elif tag in _SWALLOWING:
                        takers += (box,)
                        if tag == "pre":
                            languages = []
                            fences += (languages,)
                            leave = (node, box, leave[2], languages)
                        elif tag == "code":
                            for languages in fences:
                                languages.append(node.attrs.get("class", ""))
                    else:
                        lists += (box,)
            if inside:
                todo.append(up)
                kids, own = iter(inside), box
                break
            _leave(*leave)
            kids, leave, own, shown, takers, lists, rows, tables, fences = up
        else:
            if leave is not None:
                _leave(*leave)
            if not todo:
                return
            kids, leave, own, shown, takers, lists, rows, tables, fences = todo.pop()


def _add_text_only(tag: str, kid: Node, shown: tuple, takers: tuple, lists: tuple, rows: tuple) -> None:
    """What ``_add`` does with an element that holds one text only, at once."""
    kid.parent, text = None, kid.text
    words = text.strip(WHITE_SPACE)
    for box in takers:
        box.append(text)
    if tag == "p":
        for box in shown:
            box.append(words + "\n")
        return
    if words:
        for box in shown:
            box.append(words + " ")
    if tag == "li":
        for box in lists:
            box.append(words)
    else:
        for box in rows:
            box.append((tag == "td", words))


def _held(boxes: tuple) -> list[int]:
    """Keeps a place in each box, and gives their numbers."""
    places = []
    for box in boxes:
        places.append(len(box))
        box.append(None)
    return places


def _leave(node: Node, box: list, targets: tuple, more: list | None) -> None:
    """Renders ``box``, whose parts are complete, into ``targets``."""
    if not targets:
        return
    tag = node.tag
    if tag in ("td", "th"):
        made = (tag == "td", "".join(box).strip(WHITE_SPACE))
    elif tag == "tr":
        made = box
    elif tag == "li":
        made = "".join(box).strip(WHITE_SPACE)
    else:
        made = _rendered(tag, node, box, more)
        for target in targets:
            target.append(made)
        return
    for target, place in zip(targets, more):
        target[place] = made


def _rendered(tag: str, node: Node, box: list, languages: list | None) -> str:
    if tag == "ul":
        return "".join([f"- {item}\n" for item in box])
    if tag == "ol":
        return "".join([f"{_indent(i)}1. {item}\n" for i, item in enumerate(box)])
    if tag == "table":
        return _table(box)
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})\n"
    if tag == "hr":
        return "---\n"
    text = "".join(box).strip(WHITE_SPACE)
    if tag == "p":
        return text + "\n"
    if tag == "a":
        return f"[{text}]({node.attrs.get('href', '')})"
    if mark := _MARKS.get(tag):
        return mark + text + mark
    if tag == "pre":
        language = languages[0].removeprefix("language-") if languages else ""
        return f"```{language}\n{text}\n```\n"
    if tag == "blockquote":
        lines = [line.strip(WHITE_SPACE) for line in text.split("\n")]
        return "".join([f"> {line}\n" for line in lines if line])
    return f"{_HEADINGS[tag]}{text}\n"


def _indent(i: int) -> str:
    """One space more than the UTF-8 length of the item number as a character."""
    return " " * (2 if i < 127 else 3 if i < 2047 else 4 if i < 65535 else 5)


def _table(rows: list[list[tuple[bool, str]]]) -> str:
    """The first row with all its cells and a ruler, of the others the data cells; nothing if the first is empty."""
    if not rows or not rows[0]:
        return "\n"
    head = [cell for _, cell in rows[0]]
    lines = ["\n", _line(head), _line(["---"] * len(head))]
    for row in rows[1:]:
        if cells := [cell for is_data, cell in row if is_data]:
            lines.append(_line(cells))
    return "".join(lines)


def _line(cells: list[str]) -> str:
    return f"| {' | '.join(cells)} |\n"

"""Page-local helper of the ``nodes`` source: HTML text to a tree, by the HTML5 rules
that matter for captured pages.

Covered: raw text elements, implied html/head/body, implied end tags, reopening
and mis-nesting of formatting elements, table structure with misplaced content
moved in front of the table, and character references.  Everything after the
tree is done by Spark.
"""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

from pageloom.functions.text import C1_CHARACTERS

# Element classes of the HTML standard.
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source"
    " track wbr".split()
)
RAW_TEXT = frozenset("script style iframe noembed noframes noscript xmp plaintext".split())
RCDATA = frozenset("title textarea".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption"
    " figure footer form header hgroup listing main menu nav ol pre search section summary ul".split()
)
CLOSES_P = BLOCKS - {"button"} | HEADINGS | {"p", "li", "dd", "dt", "hr", "xmp", "plaintext"}
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = (
    BLOCKS
    | HEADINGS
    | SCOPE
    | VOID
    | RAW_TEXT
    | RCDATA
    | frozenset("body colgroup dd dt head li p select tbody tfoot thead tr".split())
)
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
TABLE_CONTEXT = frozenset("table tbody thead tfoot tr".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset(("html", "table", "template"))
IN_TABLE = TABLE_PARTS | {"script", "style"}
NO_REOPEN = CLOSES_P | RAW_TEXT | {"table", "param", "source", "track"}
SECTIONS = ("tbody", "thead", "tfoot")
CELLS = frozenset(("td", "th"))
MARKED = frozenset("td th caption applet marquee object".split())  # formatting inside them ends with them
TEXT_TAGS = RAW_TEXT | RCDATA | {"pre", "listing"}  # what follows them is read in a way of its own
ODD_ENDS = frozenset("html head body br".split())  # end tags that are more than the end of the innermost element
PART_PARENTS = {"tr": SECTIONS, "td": ("tr", *SECTIONS), "th": ("tr", *SECTIONS), "col": ("colgroup",)}
FITS = {"tr": frozenset(SECTIONS), "td": frozenset(("tr",)), "th": frozenset(("tr",))}  # rows and cells where they belong
MAX_DEPTH = 512  # as in browsers: deeper elements become siblings, nothing is lost

_COMMENT = re.compile(r"<!--(?:-?>|(.*?)(?:--!?>|\Z))", re.S)
_BOGUS = re.compile(r"<(?:[!?]|/(?![a-zA-Z]))([^>]*)(?:>|\Z)")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_DOCTYPE = re.compile(r"\s*<!doctype html", re.I)
_ATTRIBUTE = re.compile(
    r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]*)))?"""
)
_TAG_END = re.compile(r"[\s/]*>")
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")


def _character(number: str) -> str:
    """The character of a numeric reference such as ``#65;``; none is left out."""
    hexadecimal = number[1] in "xX"
    digits = number[1 + hexadecimal :].rstrip(";").lstrip("0")
    code = int(digits or "0", 16 if hexadecimal else 10) if len(digits) < 8 else -1
    if 128 <= code <= 159:
        return C1_CHARACTERS[code - 128]
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"


def decode_text(text: str) -> str:
    """Decode character references by the rule for text, where a known name may be followed by letters."""

    def decode(match: re.Match) -> str:
        name, equals = match.groups()
        return (_character(name) if name[0] == "#" else _html.unescape("&" + name)) + equals

    return _REFERENCE.sub(decode, text) if "&" in text else text


def _attribute_value(value: str) -> str:
    def decode(match: re.Match) -> str:
        name, equals = match.groups()
        if name[0] == "#":
            return _character(name) + equals
        if name not in html5 or (equals and not name.endswith(";")):
            return match.group()
        return html5[name] + equals

    return _REFERENCE.sub(decode, value) if "&" in value else value


def _plain_tags() -> dict[str, tuple[str, str]]:
    """How tags without attributes are read: ``(kind, tag)`` by what stands between the brackets."""
    found = {}
    for tag in SPECIAL | FORMATTING | TABLE_PARTS | IMPLIED_END | {"span", "label", "abbr", "cite", "sub", "sup"}:
        start = "text" if tag in TEXT_TAGS else "part" if tag in FITS else "start"
        end = "odd end" if tag in ODD_ENDS | FORMATTING else "end"
        for name in (tag, tag.upper()):
            found[name], found[f"/{name}"] = (start, tag), (end, tag)
    return found


_PLAIN, _NOT_PLAIN = _plain_tags(), ("odd", "")
_CELL_ENDS = {tag: f"/{tag}>" for tag in CELLS}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "text", "kind")

    def __init__(self, tag, attrs=None, kind="element", text=None):
        self.tag, self.kind, self.text, self.parent = tag, kind, text, None
        self.attrs, self.kids = attrs or {}, []

    def detach(self):
        if self.parent is not None:
            self.parent.kids.remove(self)
            self.parent = None

    def append(self, node, before=None):
        if node.parent is not None:
            node.detach()
        node.parent = self
        if before is None:
            self.kids.append(node)
        else:
            self.kids.insert(self.kids.index(before), node)


class TreeBuilder:
    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        self.root, self.head, self.body = Node("html"), Node("head"), None
        self.root.append(self.head)
        self.stack, self.active = [self.root], []  # None in active is a marker
        self.selects = 0  # select elements seen so far
        self.quirks = not _DOCTYPE.match(self.text)

    # -- tokens -------------------------------------------------------------
    def build(self) -> Node:
        text, stack, active = self.text, self.stack, self.active
        pieces = text.split("<")
        before, i, count = pieces[0], 1, len(pieces)  # the text in front of piece i
        place, placed = len(before), 1  # where the "<" of piece `placed` stands
        while i < count:
            name, closed, rest = pieces[i].partition(">")
            kind, tag = _PLAIN.get(name, _NOT_PLAIN) if closed else _NOT_PLAIN
            if kind != "odd":
                if before:
                    self.add_text(decode_text(before) if "&" in before else before)
                before, i = rest, i + 1
                above = stack[-1]
                if kind == "end":
                    if above.tag == tag and self.body is not None:
                        stack.pop()
                        if tag in MARKED:
                            while active and active.pop() is not None:
                                pass
                    else:
                        self.end_tag(tag)
                    continue
                if kind == "part" and above.tag in FITS[tag]:
                    node = Node(tag)
                    node.parent = above
                    above.kids.append(node)
                    if tag in CELLS:
                        if i < count and len(stack) < MAX_DEPTH and pieces[i].startswith(_CELL_ENDS[tag]):
                            if rest:  # a cell that holds one text only
                                text_node = Node(tag, None, "text", decode_text(rest) if "&" in rest else rest)
                                text_node.parent = node
                                node.kids.append(text_node)
                            before, i = pieces[i][4:], i + 1
                            continue
                        active.append(None)
                    if len(stack) < MAX_DEPTH:
                        stack.append(node)
                    continue
                if kind == "odd end":
                    self.end_tag(tag)
                    continue
                self.start_tag(tag, {}, False)
                if kind != "text":
                    continue
                place, placed = place + sum(map(len, pieces[placed:i])) + i - placed, i
                at = self.content(tag, place - len(rest))
            else:
                place, placed = place + sum(map(len, pieces[placed:i])) + i - placed, i
                at = self.step(place - len(before))
            while i < count and place < at:
                place += len(pieces[i]) + 1
                i += 1
            before, placed = text[at:place], i
        if before:
            self.add_text(decode_text(before))
        self.open_body()
        return self.root

    def step(self, at: int) -> int:
        """Text from ``at`` on and the markup behind it, of any form; gives the place behind that."""
        text = self.text
        lt = text.find("<", at)
        while lt != -1 and not (_TAG.match(text, lt) or _BOGUS.match(text, lt)):
            lt = text.find("<", lt + 1)
        stop = len(text) if lt == -1 else lt
        if stop > at:
            self.add_text(decode_text(text[at:stop]))
        return stop if lt == -1 else self.markup(lt)

    def markup(self, at: int) -> int:
        text = self.text
        if match := _COMMENT.match(text, at):
            self.add_comment(match.group(1) or "")
            return match.end()
        if match := _BOGUS.match(text, at):
            if not text[at : at + 9].lower() == "<!doctype" and match.group() != "</>":
                self.add_comment(text[at + 1 : match.end()].rstrip(">").lstrip("!/"))
            return match.end()
        match = _TAG.match(text, at)
        closing, tag, at, attrs = match.group(1), match.group(2).lower(), match.end(), {}
        while not (end := _TAG_END.match(text, at)):
            pair = _ATTRIBUTE.match(text, at)
            if not pair:  # the tag never ends
                return len(text)
            value = next((g for g in pair.groups()[1:] if g is not None), "")
            attrs.setdefault(pair.group(1).lower(), _attribute_value(value))
            at = pair.end()
        return self.tag(closing, tag, attrs, "/" in end.group(), end.end())

    def tag(self, closing: str, tag: str, attrs: dict, self_closed: bool, at: int) -> int:
        if closing:
            self.end_tag(tag)
            return at
        self.start_tag(tag, attrs, self_closed)
        return self.content(tag, at) if tag in TEXT_TAGS else at

    def content(self, tag: str, at: int) -> int:
        """Reads what follows the start tag of raw text or ``pre``."""
        text = self.text
        if tag in RAW_TEXT or tag in RCDATA:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            stop = close.start() if close and tag != "plaintext" else len(text)
            content = text[at:stop]
            if tag == "textarea":
                content = content.removeprefix("\n")
            if content and self.stack[-1].tag == tag:
                raw = content if tag in RAW_TEXT else decode_text(content)
                self.stack[-1].append(Node(tag, kind="text", text=raw))
            at = stop
        elif text.startswith("\n", at):
            at += 1
        return at

    # -- places -------------------------------------------------------------
    def open_body(self) -> None:
        if self.body is None:
            self.body = Node("body")
            self.root.append(self.body)
            self.stack[:] = self.root, self.body

    def insert(self, node: Node) -> None:
        top = self.stack[-1]
        if top.tag in TABLE_CONTEXT and node.tag not in IN_TABLE:
            table = next(n for n in reversed(self.stack) if n.tag == "table")
            top = table.parent or self.body
            top.append(node, before=table)
        else:
            top.append(node)

    def push(self, tag: str, attrs: dict | None = None) -> Node:
        node, top = Node(tag, attrs), self.stack[-1]
        if top.tag in TABLE_CONTEXT and tag not in IN_TABLE:
            self.insert(node)
        else:
            node.parent = top
            top.kids.append(node)
        if len(self.stack) < MAX_DEPTH:
            self.stack.append(node)
        return node

    def pop(self) -> Node:
        node = self.stack.pop()
        if node.tag in MARKED:
            while self.active and self.active.pop() is not None:
                pass
        return node

    def pop_until(self, tags) -> None:
        while self.pop().tag not in tags:
            pass

    def in_scope(self, tags, limits=SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in limits:
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != but:
            self.pop()

    def close_p(self) -> None:
        for node in reversed(self.stack):
            if node.tag == "p":
                self.imply_ends("p")
                self.pop_until(("p",))
                return
            if node.tag in BUTTON_SCOPE:
                return

    # -- content ------------------------------------------------------------
    def add_text(self, text: str) -> None:
        if self.body is not None and self.stack[-1].tag not in TABLE_CONTEXT:
            if self.active and self.active[-1] is not None:
                self.reconstruct()
            top = self.stack[-1]
            kids = top.kids
            if kids and kids[-1].kind == "text":
                kids[-1].text += text
            else:
                node = Node(top.tag, None, "text", text)
                node.parent = top
                kids.append(node)
            return
        blank = not text.strip("\t\n\x0c\r ")
        if self.body is None:
            if blank:
                return
            text = text.lstrip("\t\n\x0c\r ")
            self.open_body()
        top = self.stack[-1]
        if top.tag in TABLE_CONTEXT and blank:
            top.append(Node(top.tag, kind="text", text=text))
            return
        self.reconstruct()
        top = self.stack[-1]
        if top.tag not in TABLE_CONTEXT:
            if top.kids and top.kids[-1].kind == "text":
                top.kids[-1].text += text
            else:
                top.append(Node(top.tag, kind="text", text=text))
            return
        node = Node("#text", kind="text", text=text)
        self.insert(node)
        siblings = node.parent.kids
        at = siblings.index(node) if siblings[-1] is not node else len(siblings) - 1
        if at and siblings[at - 1].kind == "text":
            siblings[at - 1].text += text
            siblings.pop(at)

    def add_comment(self, text: str) -> None:
        self.stack[-1].append(Node("#comment", kind="comment", text=text))

    def start_tag(self, tag: str, attrs: dict, self_closed: bool) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self.open_body()
            target = self.root if tag == "html" else self.body
            for name, value in attrs.items():
                target.attrs.setdefault(name, value)
            return
        if self.body is None and tag in HEAD:
            node = Node(tag, attrs)
            self.head.append(node)
            self.stack[:] = (self.root, self.head, node) if tag not in VOID else (self.root, self.head)
            return
        if tag in ("head", "frameset", "frame"):
            return
        self.open_body()
        if tag in TABLE_PARTS:
            self.table_part(tag, attrs)
            return
        if self.selects and self.in_scope(("select",)):
            if tag not in ("option", "optgroup", "script", "select", "input", "textarea"):
                return
            if tag in ("select", "input", "textarea"):
                self.pop_until(("select",))
                if tag == "select":
                    return
        if tag in CLOSES_P or (tag == "table" and not self.quirks):
            if tag in ("li", "dd", "dt"):
                self.close_item(("li",) if tag == "li" else ("dd", "dt"))
            self.close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.pop()
        if tag == "a" and any(n is not None and n.tag == "a" for n in self._since_marker()):
            old = next(n for n in self._since_marker() if n.tag == "a")
            self.adopt("a")
            self.active[:] = [n for n in self.active if n is not old]
            self.stack[:] = [n for n in self.stack if n is not old]
        if tag not in NO_REOPEN:
            self.reconstruct()
        node = self.push("img" if tag == "image" else tag, attrs)
        self.selects += tag == "select"
        if tag in VOID or (self_closed and self.in_scope(("svg", "math"))):
            if self.stack[-1] is node:
                self.stack.pop()
        elif tag in FORMATTING:
            alike = [n for n in self._since_marker() if n.tag == tag and n.attrs == attrs]
            if len(alike) >= 3:
                self.active[:] = [n for n in self.active if n is not alike[0]]
            self.active.append(node)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def close_item(self, tags) -> None:
        for node in reversed(self.stack):
            if node.tag in tags:
                self.imply_ends(node.tag)
                self.pop_until((node.tag,))
                return
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str, attrs: dict) -> None:
        if self.stack[-1].tag != "table":
            if not any(n.tag == "table" for n in self.stack):
                return
            while self.stack[-1].tag not in ("table", *PART_PARENTS.get(tag, ())):
                self.pop()
        if tag in ("tr", "td", "th") and self.stack[-1].tag == "table":
            self.push("tbody")
        if tag in CELLS and self.stack[-1].tag in SECTIONS:
            self.push("tr")
        if tag == "col" and self.stack[-1].tag == "table":
            self.push("colgroup")
        node = self.push(tag, attrs)
        if tag == "col" and self.stack[-1] is node:
            self.stack.pop()
        if tag in CELLS or tag == "caption":
            self.active.append(None)

    def end_tag(self, tag: str) -> None:
        top = self.stack[-1]
        if top.tag == tag and self.body is not None and tag not in ODD_ENDS:
            if tag not in FORMATTING:
                self.pop()
                return
            if self.active and self.active[-1] is top:
                self.stack.pop()
                self.active.pop()
                return
        if tag == "head" or self.stack[-1].tag in HEAD and self.body is None:
            self.stack[:] = (self.root,) if tag == "head" else (self.root, self.head)
        elif tag in ("html", "body"):
            self.open_body()
        elif tag == "br":
            self.start_tag("br", {}, False)
        elif tag == "p":
            self.open_body()
            if not self.in_scope(("p",), BUTTON_SCOPE):
                self.push("p")
            self.close_p()
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_until(HEADINGS)
        elif tag in TABLE_PARTS or tag == "table":
            if self.in_scope((tag,), TABLE_SCOPE):
                self.pop_until((tag,))
        elif tag in BLOCKS or tag in ("li", "dd", "dt", "applet", "marquee", "object", "select"):
            if self.in_scope((tag,), LIST_SCOPE if tag == "li" else SCOPE):
                self.imply_ends(tag)
                self.pop_until((tag,))
        else:
            for node in reversed(self.stack):
                if node.tag == tag:
                    self.imply_ends(tag)
                    self.pop_until((tag,))
                    return
                if node.tag in SPECIAL:
                    return

    # -- formatting elements --------------------------------------------------
    def _since_marker(self) -> list:
        at = next((i for i in range(len(self.active), 0, -1) if self.active[i - 1] is None), 0)
        return self.active[at:]

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        pending = []
        for node in reversed(self.active):
            if node is None or node in self.stack:
                break
            pending.append(node)
        for node in reversed(pending):
            self.active[self.active.index(node)] = self.push(node.tag, node.attrs)

    def adopt(self, tag: str) -> None:
        """Close a formatting element; blocks inside it are moved out (adoption agency)."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.pop()
            return
        for _ in range(8):
            fmt = next((n for n in reversed(self._since_marker()) if n.tag == tag), None)
            if fmt is None or (fmt in self.stack and not self._open(fmt)):
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            at = self.stack.index(fmt)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            self._move_out(fmt, block, at)

    def _open(self, node: Node) -> bool:
        above = self.stack[self.stack.index(node) + 1 :]
        return not any(n.tag in SCOPE for n in above)

    def _move_out(self, fmt: Node, block: Node, at: int) -> None:
        ancestor, last = self.stack[at - 1], block
        bookmark, inner = self.active.index(fmt), 0
        for node in reversed(self.stack[at + 1 : self.stack.index(block)]):
            inner += 1
            if inner > 3 and node in self.active:
                self.active.remove(node)
            if node not in self.active:
                self.stack.remove(node)
                continue
            clone = Node(node.tag, node.attrs)
            place = self.active.index(node)
            self.active[place] = clone
            self.stack[self.stack.index(node)] = clone
            if last is block:
                bookmark = place + 1
            clone.append(last)
            last = clone
        if ancestor.tag in TABLE_CONTEXT:
            table = next(n for n in reversed(self.stack) if n.tag == "table")
            (table.parent or self.body).append(last, before=table)
        else:
            ancestor.append(last)
        clone = Node(fmt.tag, fmt.attrs)
        for kid in list(block.kids):
            clone.append(kid)
        block.append(clone)
        old = self.active.index(fmt)
        self.active.insert(bookmark, clone)
        self.active.pop(old if old < bookmark else old + 1)
        self.stack.remove(fmt)
        self.stack.insert(self.stack.index(block) + 1, clone)


def flatten(root: Node):
    """Nodes in document order as ``(node, id, end, parent, depth, sibling, ids, tags)``."""
    rows, todo, next_id = [], [(root, -1, 0, 0, (), ())], 0
    ends = []
    while todo:
        node, parent, depth, sibling, ids, tags = todo.pop()
        if node is None:  # all descendants of `parent` are numbered
            ends[parent] = next_id - 1
            continue
        here, next_id = next_id, next_id + 1
        rows.append((node, here, parent, depth, sibling, ids, tags))
        ends.append(here)
        if node.kids:
            below, names = (*ids, here), (*tags, node.tag)
            todo.append((None, here, 0, 0, (), ()))
            for at in range(len(node.kids) - 1, -1, -1):
                todo.append((node.kids[at], here, depth + 1, at, below, names))
    return rows, ends


def flatten_into(root: Node, out: dict[str, list]) -> int:
    """Adds the nodes of a tree in document order to lists, and gives their number.

    ``up`` takes the ancestors of all nodes, root first, one after another, and ``n_up`` how many each has.
    Nodes lose their parents, so that a tree is freed at once and leaves the collector nothing to look for.
    """
    parents, kinds, tags, texts = [], [], [], []
    attrs, up, n_up = out["attrs"], out["up"], out["n_up"]
    todo = [(root, -1, (), "")]
    while todo:
        node, parent, ids, above = todo.pop()
        node.parent = None
        here, kind = len(parents), node.kind
        parents.append(parent)
        kinds.append(kind)
        tags.append(node.tag if kind == "element" else above)
        texts.append(node.text)
        attrs.append(list(node.attrs.items()) if node.attrs else None)
        up.extend(ids)
        n_up.append(len(ids))
        if node.kids:
            below, tag = (*ids, here), node.tag
            todo.extend([(kid, here, below, tag) for kid in reversed(node.kids)])
    size = len(parents)
    ends = list(range(size))
    for here in range(size - 1, 0, -1):
        parent = parents[here]
        if ends[here] > ends[parent]:
            ends[parent] = ends[here]
    for name, values in (("n", range(size)), ("end", ends), ("parent", parents), ("kind", kinds), ("tag", tags), ("text", texts)):
        out[name].extend(values)
    return size

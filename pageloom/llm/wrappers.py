"""HTML extraction by wrapper induction.

Each host has a reference page, the one with its smallest id.  The element tree
of every page is aligned with the reference's by simple tree matching: the best
order-keeping pairing of children, from the leaves up, where runs of siblings of
one kind count as one repeated slot.  A text that stands in the same slot with
the same words on most of the host's pages is constant: template.  Slots whose
text varies are content.  Pages whose text is largely the reference's own (copies
and near copies) say nothing about constancy and are left out of its count, so
that a host of copies keeps its content.

What varies need not be article text (menus and adverts vary, too).  So the
content is all that is not template, in page order, without the elements that are
never article text by their tag, role or class.

Whole pages are parsed, twice if their host has constant texts.  The reference
goes to its pages by a join on the host that a hot host does not overload, or by
broadcast if all references together are counted small.

Defined results: NULL and empty html give an empty text; a page with NULL url has
no host and is read without a template; repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import stored

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What is never article text.
DROPPED_TAGS = frozenset(
    "nav header footer aside form script style template iframe noscript button select textarea svg math"
    " dialog menu head title object embed canvas audio video noembed noframes search".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion"
    " sidebar sidebars side nav navbar navigation navi menu menus breadcrumb breadcrumbs footer header masthead"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " share sharing social related recommended"
    " widget widgets toolbar pager pagination skip hidden login".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?"
    r"|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMERIC = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?")
_WORD = re.compile(r"[a-z]+")
_STYLE_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CONSTANT, LEAST_PAGES = 0.8, 3


def _character(m: re.Match) -> str:
    code = int(m[1], 16) if m[1] else int(m[2])
    if 128 <= code < 160:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    if code == 0 or 0xD800 <= code < 0xE000 or code > 0x10FFFF:
        return "�"
    # A decoded "&" must not start another reference.
    return "&amp;" if code == 38 else chr(code)


def decode(text: str) -> str:
    """Character references by the rules for text; none is dropped."""
    if "&" not in text:
        return text
    return entities.unescape(_NUMERIC.sub(_character, text))


class Tree:
    """Elements in document order as parallel lists, and the texts between the tags.

    ``texts`` holds ``(element, text)`` and ``(element, None)`` for a break.
    """

    def __init__(self, page: str):
        self.tag, self.attributes, self.parent, self.end = ["#"], [""], [-1], [0]
        self.texts: list[tuple[int, str | None]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, at, texts = [0], 0, self.texts
        for m in iter(lambda: _TAG.search(page, at), None):
            if m.start() > at:
                texts.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "br":
                    texts.append((stack[-1], None))
                else:
                    self._close(stack, {name})
                continue
            if name in CLOSES_P:
                self._close(stack, {"p"}, {"button", "table", "td", "th", "caption"})
            elif name in CLOSED_BY:
                closed, scope = CLOSED_BY[name]
                while self._close(stack, closed, scope):
                    pass
            node = len(self.tag)
            self.tag.append(name)
            self.attributes.append(m[3])
            self.parent.append(stack[-1])
            self.end.append(0)
            if name in VOID or (m[3].endswith("/") and name not in INLINE and name in ("svg", "path")):
                self.end[node] = node
                texts.append((node, None if name not in INLINE else ""))
                continue
            stack.append(node)
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                at = close.start() if close else len(page)
        if at < len(page):
            texts.append((stack[-1], page[at:]))
        for node in stack:
            self.end[node] = len(self.tag) - 1

    def _close(self, stack: list[int], names: set[str], scope: set[str] | frozenset[str] = frozenset()) -> bool:
        """Closes the innermost open element of ``names`` that is not behind one of ``scope``."""
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                for node in stack[k:]:
                    self.end[node] = len(self.tag) - 1
                del stack[k:]
                return True
            if self.tag[stack[k]] in scope:
                return False
        return False

    def dropped(self) -> list[bool]:
        """Elements that are never article text, with all that is in them.

        A class such as "with-sidebar" on an element around the article, or around
        most of the page's text, says nothing about what is in it.
        """
        holds = [t in ("article", "main") for t in self.tag]
        size = [0] * (len(self.tag) + 1)
        for node, text in self.texts:
            size[node] += len(text or "")
        total = sum(size)
        for node in range(len(self.tag) - 1, 0, -1):
            size[self.parent[node]] += size[node]
            if holds[node]:
                holds[self.parent[node]] = True
        gone = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            if gone[self.parent[node]]:
                gone[node] = True
            elif self.tag[node] in DROPPED_TAGS:
                gone[node] = not (self.tag[node] == "form" and holds[node])
            elif self.attributes[node].strip():
                sure, likely = self._boilerplate(node)
                around = (holds[node] and self.tag[node] != "article") or 2 * size[node] > total
                gone[node] = sure or (likely and not around)
        return gone

    def _attribute_values(self, node: int) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attributes[node]):
            found.setdefault(m[1].lower(), decode(m[2] or m[3] or m[4] or "").lower())
        return found

    def _boilerplate(self, node: int) -> tuple[bool, bool]:
        """Whether an element is certainly, or likely, not article text by its attributes."""
        if self.tag[node] in ("html", "body"):
            return False, False
        values = self._attribute_values(node)
        words = _WORD.findall(values.get("class", "") + " " + values.get("id", ""))
        sure = (
            "hidden" in values
            or values.get("aria-hidden") == "true"
            or _STYLE_HIDES.search(values.get("style", "")) is not None
            or any(w in COMMENT_WORDS for w in words)
        )
        return sure, values.get("role") in DROPPED_ROLES or any(w in DROPPED_WORDS for w in words)

    def kind(self, node: int) -> str:
        return self.tag[node]

    def children(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in self.tag]
        for node in range(1, len(self.tag)):
            if self.tag[node] not in INLINE and self.tag[node] not in VOID:
                # Inline elements are part of their block; what is in them belongs to it.
                up = self.parent[node]
                while self.tag[up] in INLINE:
                    up = self.parent[up]
                below[up].append(node)
        return below

    def pieces(self, gone: list[bool] | None = None) -> str:
        """Text of the elements in page order: blocks and white space give one space."""
        out: list[str] = []
        block = None
        for node, text in self.texts:
            if gone and gone[node]:
                continue
            own = node
            while self.tag[own] in INLINE:
                own = self.parent[own]
            if own != block:
                out.append(" ")
                block = own
            out.append(" " if text is None else decode(text))
        return " ".join("".join(out).split())


def blocks(tree: Tree, gone: list[bool]) -> dict[int, int]:
    """Hash of the own text of every block element that has any."""
    parts: dict[int, list[str]] = {}
    for node, text in tree.texts:
        if gone[node] or not text:
            continue
        own = node
        while tree.tag[own] in INLINE:
            own = tree.parent[own]
        parts.setdefault(own, []).append(text)
    hashed = {}
    for own, texts in parts.items():
        text = " ".join(decode("".join(texts)).split())
        if text:
            hashed[own] = zlib.crc32(text.encode("utf-8", "replace"))
    return hashed


def _runs(tree: Tree, nodes: list[int]) -> list[list[int]]:
    """Neighbours of one kind as one repeated slot."""
    runs: list[list[int]] = []
    for node in nodes:
        if runs and tree.kind(runs[-1][0]) == tree.kind(node):
            runs[-1].append(node)
        else:
            runs.append([node])
    return runs


class Alignment:
    """Simple tree matching of a page with a reference; ``slot`` maps elements to reference slots.

    Elements with the same tag and the same slots below have one form, so that each
    pair of forms is matched once.  The matching is exact at any width and depth.
    """

    def __init__(self, page: Tree, reference: Tree):
        self.ids: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.full: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.paired: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.slot: dict[int, int] = {0: 0}
        self._follow(*self._forms(page), *self._forms(reference))

    def _forms(self, tree: Tree) -> tuple[list[list[list[int]]], list[int]]:
        """Slots below every element, and the number of its form."""
        slots, forms = [_runs(tree, nodes) for nodes in tree.children()], [0] * len(tree.tag)
        for node in range(len(tree.tag) - 1, -1, -1):
            below = tuple(forms[run[0]] for run in slots[node])
            form = forms[node] = self.ids.setdefault((tree.kind(node), below), len(self.tags))
            if form == len(self.tags):
                self.tags.append(tree.kind(node))
                self.below.append(below)
                self.full.append(1 + sum(self.full[f] for f in below))
        return slots, forms

    def _open(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pairs of forms below two forms whose weights are not known yet."""
        ours, theirs = set(self.below[a]), set(self.below[b])
        return [
            (x, y) for x in ours for y in theirs
            if x != y and self.tags[x] == self.tags[y] and (x, y) not in self.weights
        ]

    def _weigh(self, a: int, b: int) -> None:
        """Weights of all pairs below: pairs in the best match of the two trees."""
        todo = self._open(a, b)
        while todo:
            x, y = todo[-1]
            if (x, y) in self.weights:
                todo.pop()
            elif more := self._open(x, y):
                todo += more
            else:
                best = np.zeros(len(self.below[y]) + 1, np.int64)
                for gain in self._gains(x, y):
                    best = self._row(best, gain)
                self.weights[x, y] = 1 + int(best[-1])
                todo.pop()

    def _gains(self, a: int, b: int, low: int = 0, high: int | None = None) -> Iterator[np.ndarray]:
        """Weights of each slot of ``a``, from ``low`` to ``high``, with all slots of ``b``."""
        forms, place = np.unique(np.array(self.below[b], np.int64), return_inverse=True)
        known: dict[int, np.ndarray] = {}
        for x in self.below[a][low:high]:
            if x not in known:
                known[x] = np.array([self.full[x] if x == y else self.weights.get((x, y), 0) for y in forms.tolist()], np.int64)
            yield known[x][place]

    @staticmethod
    def _row(best: np.ndarray, gain: np.ndarray) -> np.ndarray:
        row = np.zeros_like(best)
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + gain), out=row[1:])
        return row

    def _pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of paired slots of two forms of one tag."""
        if self.below[a] == self.below[b]:
            return [(k, k) for k in range(len(self.below[a]))]
        if (a, b) not in self.paired:
            self._weigh(a, b)
            n = len(self.below[a])
            # Every step-th row is kept; the rows between are made again on the way back.
            step, best = math.isqrt(n) + 1, np.zeros(len(self.below[b]) + 1, np.int64)
            kept = []
            for i, gain in enumerate(self._gains(a, b)):
                if i % step == 0:
                    kept.append(best)
                best = self._row(best, gain)
            pairs, j = [], len(self.below[b])
            for k in range(len(kept) - 1, -1, -1):
                rows = [kept[k]]
                for gain in self._gains(a, b, k * step, (k + 1) * step):
                    rows.append(self._row(rows[-1], gain))
                i = len(rows) - 1
                while i and j:
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((k * step + i, j))
            self.paired[a, b] = pairs[::-1]
        return self.paired[a, b]

    def _follow(self, ours: list, our_forms: list[int], theirs: list, their_forms: list[int]) -> None:
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            for i, j in self._pairs(our_forms[a], their_forms[b]):
                slot = theirs[b][j]
                for k, node in enumerate(ours[a][i]):
                    self.slot[node] = slot[0]
                    todo.append((node, slot[min(k, len(slot) - 1)]))


def slot_texts(tree: Tree, gone: list[bool]) -> dict[int, set[int]]:
    """Text hashes by slot of a reference."""
    slots: dict[int, set[int]] = {}
    first = {node: run[0] for nodes in tree.children() for run in _runs(tree, nodes) for node in run}
    for node, text in blocks(tree, gone).items():
        slots.setdefault(first.get(node, node), set()).add(text)
    return slots


class _References:
    """Parsed reference pages of the hosts a worker meets."""

    def __init__(self):
        self.known: dict[int, tuple] = {}

    def get(self, page: str) -> tuple[Tree, dict[int, set[int]], set[int]]:
        key = hash(page)
        if key not in self.known:
            if len(self.known) >= 500:
                self.known.clear()
            tree = Tree(page)
            slots = slot_texts(tree, tree.dropped())
            self.known[key] = tree, slots, set().union(*slots.values())
        return self.known[key]


_references = _References()


def constants(host: str, page: str, reference: str) -> list[tuple[str, int, int]]:
    """``(host, slot, text)`` where a page has the reference's text, after ``(host, -1, 0)``.

    Nothing for a page that has half of its texts from the reference.
    """
    other, slots, texts = _references.get(reference)
    tree = Tree(page)
    own = blocks(tree, tree.dropped())
    if not own or 2 * sum(t in texts for t in own.values()) > len(own):
        return []
    if texts.isdisjoint(own.values()):
        return [(host, -1, 0)]
    slot = Alignment(tree, other).slot
    same = {(slot[n], t) for n, t in own.items() if n in slot and t in slots.get(slot[n], ())}
    return [(host, -1, 0), *((host, s, t) for s, t in sorted(same))]


def extract(page: str | None, reference: str | None = None, template: frozenset = frozenset()) -> str:
    """The main text of one page; ``template`` holds ``(slot, text)`` of the reference."""
    if not page:
        return ""
    tree = Tree(page)
    gone = tree.dropped()
    if template and reference:
        own = blocks(tree, gone)
        slot = Alignment(tree, _references.get(reference)[0]).slot
        for node, text in own.items():
            if (slot.get(node), text) in template:
                gone[node] = True
        for node in range(1, len(gone)):
            gone[node] = gone[node] or (gone[tree.parent[node]] and tree.tag[node] in INLINE)
    return tree.pieces(gone)


MAX_BROADCAST_BYTES = 16 << 20
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)"


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every row of ``pages``."""
    host = F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    first = stored(
        rows.where("host IS NOT NULL AND html <> ''").groupBy("host").agg(F.min("page_id").alias("page_id")),
        "first_pages",
    )
    chosen = F.broadcast(first) if first.count() <= 100_000 else first
    references = stored(
        rows.join(chosen, ["host", "page_id"])
        .groupBy("host")
        .agg(F.min("html").alias("reference")),
        "references",
    )
    counted = stored(_count_constants(_with(rows.where("html <> ''"), references)), "constants")
    pages_of = counted.where("slot = -1").select("host", F.col("n").alias("pages"))
    common = (
        counted.where("slot >= 0")
        .join(pages_of, "host")
        .where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("pages")))
        .groupBy("host")
        .agg(F.collect_list(F.struct("slot", "text")).alias("template"))
    )
    # Only hosts with constant texts need their reference again.
    wrappers = stored(references.join(common, "host"), "wrappers")
    return _with(rows, wrappers).mapInArrow(_extractor, "page_id bigint, url string, text string")


def _with(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Rows with what is known of their host; rows of other hosts have NULLs."""
    columns = [F.octet_length("reference")]
    size = references.select(F.sum(columns[0])).first()[0] or 0
    return rows.join(F.broadcast(references) if size <= MAX_BROADCAST_BYTES else references.hint("merge"), "host", "left")


def _count_constants(rows: DataFrame) -> DataFrame:
    """``(host, slot, text, n)``: on how many informative pages a text stands in a slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for host, page, reference in zip(batch["host"], batch["html"], batch["reference"]):
                if reference.is_valid:
                    seen.update(constants(host.as_py(), page.as_py(), reference.as_py()))
            yield pa.RecordBatch.from_pydict(
                {
                    "host": pa.array([k[0] for k in seen], pa.string()),
                    "slot": pa.array([k[1] for k in seen], pa.int32()),
                    "text": pa.array([k[2] for k in seen], pa.int64()),
                    "n": pa.array(list(seen.values()), pa.int64()),
                }
            )

    partial = rows.select("host", "html", "reference").mapInArrow(
        count, "host string, slot int, text bigint, n bigint"
    )
    return partial.groupBy("host", "slot", "text").agg(F.sum("n").alias("n"))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, reference, template in zip(batch["html"], batch["reference"], batch["template"]):
            known = frozenset((t["slot"], t["text"]) for t in template.as_py()) if template.is_valid else frozenset()
            texts.append(extract(page.as_py(), reference.as_py(), known))
        yield pa.RecordBatch.from_pydict(
            {"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string())}
        )
